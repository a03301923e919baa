"""The listing that tests vary, and helpers around it."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

NOW = datetime(2026, 9, 21, 12, tzinfo=timezone.utc)

BASE = {
    "source": "freelance_ru", "source_id": "5150", "title": "Починить вебхуки оплаты в сервисе на FastAPI",
    "description": "В работающем сервисе теряются уведомления о платежах: исправить обработчик, повторить доставку через API банка, "
                   "написать проверку на три сценария. Репозиторий и журнал ошибок дадим сразу, 2 дня на всё.",
    "url": "https://freelance.ru/task/view/5150", "published_at": NOW, "publication_confirmed": True,
    "publication_evidence": "fixture clock", "open_status": "open", "status_evidence": "fixture button",
    "budget_min": Decimal(14000), "budget_max": Decimal(18500), "currency": "RUB", "responses_count": 1,
    "origin_kind": "marketplace",
}


def hours_ago(hours):
    return None if hours is None else NOW - timedelta(hours=hours)


def by_row(df):
    return [r for r in sorted(df.collect(), key=lambda r: r["row_id"])]
