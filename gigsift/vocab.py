"""Fixed values.

Everything in this file is data that has to be equal to the published behaviour for results to match: word lists,
patterns, thresholds, labels, message texts. There is no logic here; `rules.py` bundles the editable part.

Patterns are written in the common subset of regular expressions. `functions.text.rx` adds the flags which make
Java treat them as Unicode, case-insensitive patterns.
"""

# --- lexicons -------------------------------------------------------------------------------------------------

POSITIVE_TERMS = (
    "telegram bot", "telegram-бот", "бот", "chatbot", "python", "django", "fastapi",
    "flask", "api", "rest api", "webhook", "n8n", "automation", "автоматизация",
    "парсер", "парсинг", "scraping", "react", "javascript", "typescript", "node.js",
    "доработать сайт", "доработка сайта", "bug", "ошибка", "интеграция", "1с", "унф",
    "docker", "linux", "vps", "aiogram", "backend", "frontend", "fullstack", "sql", "postgresql",
)

NEGATIVE_TERMS = (
    "копирайтинг", "отзывы", "карточки товаров", "анкеты", "powerpoint", "презентации",
    "photoshop", "ретушь", "перевод", "контент-менеджмент", "наполнение сайта",
    "продажи", "поиск клиентов", "холодные звонки", "дизайн", "логотип", "excel",
    "google docs", "оператор маркетплейса", "рассылка контента", "тексты", "smm",
    "seo продвижение", "монтаж", "анимация", "3d",
)

TERM_PATTERNS = {
    "telegram bot": r"telegram[\s-]+bots?",
    "telegram-бот": r"telegram[\s-]+бот(?:а|ы|ов|у|ом|ами)?",
    "бот": r"бот(?:а|ы|ов|у|ом|ами)?|bots?",
    "автоматизация": r"автоматизац\w*|автоматизир\w*",
    "парсер": r"парсер\w*",
    "парсинг": r"парсинг\w*",
    "доработать сайт": r"доработ\w*\s+сайт\w*",
    "доработка сайта": r"доработ\w*\s+сайт\w*",
    "bug": r"bugs?|баг\w*",
    "ошибка": r"ошибк\w*",
    "интеграция": r"интеграц\w*",
    "1с": r"1[сc](?::\w+)?",
    "дизайн": r"дизайн\w*",
    "логотип": r"логотип\w*",
    "копирайтинг": r"копирайт\w*",
    "тексты": r"текст(?:ы|ов|ами)",
    "отзывы": r"отзыв\w*",
    "карточки товаров": r"карточ\w*\s+(?:товар\w*|маркетплейс\w*)",
    "анкеты": r"анкет\w*",
    "презентации": r"презентац\w*|слайд\w*",
    "photoshop": r"photoshop|фотошоп\w*",
    "ретушь": r"ретуш\w*",
    "перевод": r"перевод\w*|перевести|translation",
    "контент-менеджмент": r"контент[-\s]+менедж\w*",
    "наполнение сайта": r"(?:наполн\w*|заполн\w*)\s+сайт\w*",
    "продажи": r"продаж\w*",
    "поиск клиентов": r"(?:поиск|искать|найти)\s+клиент\w*",
    "холодные звонки": r"холодн\w*\s+звон\w*",
    "оператор маркетплейса": r"(?:оператор|менеджер)\w*\s+маркетплейс\w*",
    "рассылка контента": r"(?:рассыл\w*|размещ\w*|публиков\w*)\s+контент\w*",
    "seo продвижение": r"seo[-\s]+продвижени\w*",
}

# --- relevance patterns ---------------------------------------------------------------------------------------

IMPLEMENTATION_INTENT = (
    r"\bавтоматизир\w*|\b(?:automation|автоматизация|парсинг|scraping)\s+(?:процесс\w*|заполн\w*|карточ\w*|данн\w*|сбор\w*)|"
    r"\b(?:разработ\w*|созда\w*|напис\w*|доработ\w*|исправ\w*|настро\w*|внедр\w*|интегр\w*|подключ\w*|build|develop|fix)\s+"
    r"(?:и\s+(?:адаптивн\w*\s+)?в[её]рстк\w*\s+)?"
    r"(?:(?:нов\w*|существующ\w*|небольш\w*|программ\w*|telegram|aiogram|python|react|rest|веб|web)[\s-]+){0,3}"
    r"(?:бот\w*|bots?\b|chatbot\b|api\b|webhook\b|n8n\b|парсер\w*|скрипт\w*|код\w*|"
    r"приложени\w*|app\b|сайт\w*|баг\w*|интеграц\w*|модул\w*|сервис\w*|1[сc]\b|"
    r"saas\b|crm\b|erp\b|маркетплейс\w*|marketplace\b|плагин\w*|комплекс\w*|обеспечени\w*)|"
    r"\b(?:бот\w*|скрипт\w*|парсер\w*|api|n8n)\s+(?:для|на|через)\b"
)
TECHNICAL_CATEGORY = (
    r"программирован\w*|\bprogramming\b|программное\s+обеспечение|(?:веб|web)[-\s]+(?:разработ\w*|development)|"
    r"chatbot\s+development|разработ\w*\s+(?:чат[-\s]*)?бот\w*|automation|автоматизац\w*|"
    r"\b(?:api|python|1[сc]|devops)\b"
)
SOFTWARE_PRODUCT = r"\b(?:saas|crm|erp|marketplace|маркетплейс\w*|mobile\s+app|мобильн\w*\s+приложени\w*)\b"
MANUAL_ACTION = (
    r"вручную|копирайт\w*|контент[-\s]+менедж\w*|оператор\w*|холодн\w*\s+звон\w*|"
    r"(?:напис\w*|писать|созда\w*|запол\w*|напол\w*|состав\w*|исправ\w*|размещ\w*|рассыл\w*)"
    r".{0,45}(?:отзыв\w*|стать\w*|слайд\w*|презентац\w*|анкет\w*|карточ\w*|прайс\w*|текст\w*|контент\w*)"
)

RELEVANCE_TEXT = {
    "manual": "Основная задача — ручная или непрофильная работа: ",
    "none": "Нет технических ключевых слов или категории; Telegram сам по себе недостаточен",
    "keywords": "Технические признаки: ",
    "category": "Техническая категория: ",
    "product": "Явная разработка программного продукта",
}
SKIP_TEXT = {
    "advertisement": "Рекламный пост",
    "education": "Продвижение обучения",
    "full_time_vacancy": "Full-time вакансия без признаков разового проекта",
}

# --- stack ----------------------------------------------------------------------------------------------------

STACK_HIGH = {
    "Python": r"python|питон\w*|django|flask",
    "Telegram Bot API": r"telegram[\s-]+(?:bot(?:s|\s+api)?|бот\w*)|бот\w*\s+(?:для|в)\s+telegram",
    "aiogram": r"aiogram",
    "FastAPI": r"fastapi",
    "REST API": r"(?:rest\s+)?api",
    "webhooks": r"webhooks?|вебху\w*",
    "n8n": r"n8n",
    "automation": r"automation|автоматизац\w*|автоматизир\w*",
    "parsing/scraping": r"parsing|scraping|парсинг\w*|парсер\w*|скрейпинг\w*",
    "JavaScript": r"javascript|js",
    "TypeScript": r"typescript|ts",
    "React": r"react(?:\.js|js)?",
    "Node.js": r"node(?:\.js|js)",
    "Docker": r"docker",
    "Linux": r"linux",
    "VPS": r"vps|vds",
    "SQL/PostgreSQL": r"sql|postgresql|postgres",
}
STACK_PARTIAL = {
    "PHP": r"php(?:\s*\d+(?:\.\d+)*)?|laravel|symfony",
    "WordPress": r"wordpress|вордпресс",
    "OpenCart": r"opencart|опенкарт",
    "payment integrations": r"payment\s+integrations?|плат[её]жн\w*\s+(?:систем\w*|шлюз\w*|интеграц\w*)|"
                            r"(?:интеграц\w*|подключ\w*)\s+(?:оплат\w*|плат[её]ж\w*)|stripe|paddle|lemonsqueezy|юкасса|yookassa",
    "Google APIs": r"google\s+(?:(?:maps|sheets|drive|calendar|ads|analytics|docs)\s+)?apis?|"
                   r"api\s+google(?:\s+\w+)?",
    "Bitrix": r"bitrix(?:24)?|битрикс(?:24)?",
}
STACK_LOW = {
    "Ruby / Ruby on Rails": r"ruby(?:\s+on\s+rails)?|rails|ror",
    "Java": r"java(?:\s*\d+)?|джава|spring(?:\s+boot)?",
    "C# / .NET": r"c#|csharp|c-sharp|\.net|asp\.net",
    "C++": r"c\+\+(?:\d+)?",
    "Flutter": r"flutter|dart",
    "Kotlin": r"kotlin",
    "Swift": r"swift",
    "Android": r"android|андроид\w*",
    "Tilda": r"tilda|тильд\w*",
    "Cleverence": r"cleverence|клеверенс\w*",
    "GetCourse": r"get\s*course|гет\s*курс\w*",
    "Go": r"golang|go",
    "Rust": r"rust",
    "Elixir": r"elixir",
    "Windows/RDP": r"windows(?:\s+server)?|rdp",
}
ONE_C = r"1[сc](?::\w+)?|унф"
ONE_C_INTEGRATION = (
    r"интеграц\w*|обмен\w*|\bapi\b|integration|exchange|прост\w*\s+расширени\w*|simple\s+extension"
)
ONE_C_LABELS = ("1C integration / exchange / simple extension", "1C programming")
DEEP_ONE_C = (
    r"(?:перенос\w*|перенест\w*|миграц\w*).{0,60}(?:полноценн\w*|полн\w*|вс[еюя]\w*).{0,25}конфигурац\w*|"
    r"(?:перенос\w*|перенест\w*|миграц\w*)\s+(?:баз\w*(?:\s+данн\w*)?\s+и\s+)?конфигурац\w*|"
    r"(?:архитектур\w*|переработ\w*).{0,40}конфигурац\w*|"
    r"(?:сложн\w*|крупн\w*).{0,35}(?:erp|ер[пp]|модул\w*)|"
    r"(?:крупн\w*|масштабн\w*|комплексн\w*|полноценн\w*).{0,30}внедрен\w*|"
    r"(?:разработ\w*|внедрен\w*|внедрить).{0,40}\berp\b|"
    r"(?:full\s+)?configuration\s+(?:migration|transfer)|configuration\s+architecture|"
    r"complex\s+(?:erp\s+)?modules?|large[- ]scale\s+implementation"
)

# words which make the next technology name an exclusion, with the width of text before it that is looked at
NEGATORS_BEFORE = ("без", "не используем", "not using", "without")
NEGATION_WIDTH_BEFORE = 40
EXPERIENCE_WORD = "опыт"
NEGATED_AFTER = r"\s+(?:не\s+(?:нуж\w*|требует\w*|использует\w*)|not\s+(?:required|needed))\b"

DECLARED_STACK = r"(?:стек|stack|язык|framework|фреймворк|технологии)\s*[:—-]\s*([^;\n]{1,160})"
DECLARED_SENTENCE_END = r"[.!?](?=\s+[А-ЯA-Z])"
DECLARED_TOKEN = r"(?<!\w)(?:c\+\+\d*|c#|\.net|[A-Za-z][A-Za-z0-9]*(?:[.-][A-Za-z0-9]+)*)"
REQUIRED_TOKEN = (
    r"(?:\bна|\busing|\brequires|\bтребуется|\bобязателен|\bнужен|\bиспользуется)\s+"
    r"(?:(?:язык|фреймворк|стек|разработчик|программист)\s+)?([A-Za-z][A-Za-z0-9.+#-]*)"
)
TOKEN_STOP_WORDS = (
    "and", "or", "with", "on", "the", "a", "an", "и", "bot", "rest", "google", "telegram",
    "not", "required", "needed", "senior", "middle", "junior", "developer", "backend", "frontend", "fullstack",
)

HIGH_MATCH, PARTIAL_MATCH, LOW_UNKNOWN_MATCH = "HIGH_MATCH", "PARTIAL_MATCH", "LOW_UNKNOWN_MATCH"
STACK_POINTS = {HIGH_MATCH: 2, PARTIAL_MATCH: 0, LOW_UNKNOWN_MATCH: -3}
STACK_TEXT = {
    "low": "Не подтверждён опыт с обязательным стеком: ",
    "partial": "Частичное совпадение: ",
    "high": "Основной стек: ",
    "none": "Стек не указан или не распознан; опыт не подтверждён",
}

# --- scoring --------------------------------------------------------------------------------------------------

SPECIALIZATION_GROUPS = (
    ("telegram bot", "telegram-бот", "бот", "chatbot", "aiogram"),
    ("python", "django", "fastapi", "flask"),
    ("api", "rest api", "webhook", "интеграция"),
    ("n8n", "автоматизация", "automation"),
    ("парсер", "парсинг", "scraping"),
    ("react", "javascript", "typescript", "node.js", "доработать сайт", "доработка сайта", "bug", "ошибка",
     "backend", "frontend", "fullstack"),
    ("1с", "унф"),
    ("docker", "linux", "vps"),
    ("sql", "postgresql"),
)
COMPLEXITY_TERMS = ("1с", "унф", "api", "docker")
CONCRETE_BRIEF = r"добав\w*|исправ\w*|настро\w*|интегр\w*|получ\w*|выгруз\w*|сохран\w*|endpoint|webhook|csv|json|xlsx"
CONCRETE_MIN_CHARS = 80
EXISTING_PROJECT = r"доработ\w*|исправ\w*|bug\s*fix|существующ\w*|готов\w*\s+(?:сайт|проект|бот|код)"
DURATION = (
    r"(?:срок(?:\s+выполнения)?\s*[:—-]?|за|до)\s*(\d+)\s*(?:[-–—]\s*(\d+)\s*)?\+?\s*"
    r"(?:рабочих\s+)?(?:дн\w*|день|days?)"
)
LARGE_PRODUCT = (
    r"(?:маркетплейс\w*|marketplace|мобильн\w*\s+приложени\w*|mobile\s+app|saas(?:\s+platform)?|crm|erp)"
)
FROM_SCRATCH = r"(?:с\s+нуля|from\s+scratch)"
LARGE_ROLLOUT = r"enterprise\s+implementation|(?:корпоративн\w*|масштабн\w*)\s+внедрен\w*|внедрен\w*.{0,25}\berp\b"
EXPERIENCE_NOT_NEEDED = r"(?:опыт|кейсы|портфолио)\s+не\s+(?:требует\w*|обязател\w*|нуж\w*)"
EXPERIENCE_YEARS = r"(?<!\w)(\d+)\s*(?:[-–—]\s*(\d+)\s*)?(\+)?\s*(?:лет|год\w*|years?)"
EXPERIENCE_CONTEXT = (
    r"(?:требует\w*|требован\w*|обязател\w*|необходим\w*|опыт\b|experience\b|required|mandatory|must|только)"
)
EXPERIENCE_CASES = (
    r"(?:кейс\w*|портфолио|senior).{0,40}(?:обязател\w*|required|mandatory|only)|"
    r"подтвержд[её]н\w*\s+(?:кейс\w*|внедрен\w*)|рекомендаци\w*\s+клиент\w*|verified\s+(?:cases|portfolio)"
)
EXPERIENCE_CASES_AFTER = r".{0,60}(?:кейс\w*|портфолио|senior)"

REASON_TEXT = {
    "base": "Базовая оценка технического проекта",
    "deep_1c": "DEEP_1C: глубокая разработка или внедрение 1С; опыт не подтверждён",
    "unconfirmed_publication": "Hard skip: время публикации не подтверждено исходной биржей",
    "invalid_direct_url": "Hard skip: нет прямой ссылки на карточку исходной биржи",
    "closed_project": "Hard skip: проект закрыт, исполнитель выбран или отклики не принимаются",
    "unknown_date": "Hard skip: нет достоверного времени публикации",
    "future_date": "Hard skip: дата публикации в будущем; свежесть не подтверждена",
    "stale": "Hard skip: старше %d часов",
    "fresh": "Возраст %s ч; бонус свежести %+d",
    "concrete": "Есть конкретные действия или формат результата в ТЗ",
    "unknown_budget": "Бюджет не указан",
    "foreign_budget": "Валюта не RUB или неизвестна: оценка по курсу не выполнялась",
    "budget_too_low": "Hard skip: бюджет ниже 3 000 RUB",
    "budget_small": "Бюджет 3 000–4 999 RUB",
    "budget_target": "Бюджет в целевом диапазоне 5 000–30 000 RUB",
    "budget_above": "Бюджет выше целевого диапазона, до 100 000 RUB",
    "budget_large": "Бюджет больше 100 000 RUB",
    "unknown_responses": "Количество откликов неизвестно",
    "competition": "Откликов: %d; конкуренция %+d",
    "existing": "Доработка или исправление существующего проекта",
    "short_task": "Указан срок 1–5 дней",
    "long_task": "Указанный срок больше 10 дней",
    "large_project": "LARGE_PROJECT: крупный бюджет, продукт с нуля, внедрение ERP/enterprise или срок 30+ дней",
    "experience_gate": "EXPERIENCE_GATE: требуется опыт 3+ года, обязательные кейсы, внедрения, рекомендации или Senior",
    "hard_skip": "Отправка запрещена safety gate или бюджетом; итог не выше 5",
    "fire_age_limit": "FIRE запрещён: старше %d часов; итог не выше 7",
    "fire_blocked": "FIRE запрещён: крупный проект или обязательный опыт; итог не выше 7",
    "competition_cap": "FIRE запрещён: число откликов неизвестно или больше 20; итог не выше %d",
    "partial_stack_cap": "PARTIAL_MATCH: FIRE запрещён, максимум GOOD 7/10",
    "open_status_cap": "Нет подтверждения приёма откликов: максимум GOOD 7/10",
    "deep_1c_cap": "DEEP_1C: максимум GOOD 6/10",
    "stack_score_cap": "STACK_MISMATCH: FIRE запрещён, максимум GOOD 6/10",
}

# --- record vocabularies --------------------------------------------------------------------------------------

ORIGIN_KINDS = ("marketplace", "direct_post", "repost")
SKIP_REASONS = ("advertisement", "education", "full_time_vacancy")
OPEN_STATUSES = ("unknown", "open", "closed", "awarded", "not_accepting")
CLOSED_STATUSES = ("closed", "awarded", "not_accepting")
STATE_STATUSES = ("seen", "pending", "sent")

# --- sources --------------------------------------------------------------------------------------------------

SOURCE_ORDER = ("freelance_ru", "habr_freelance", "fl_ru", "telegram_public", "weblancer")
SOURCES_OFF_BY_DEFAULT = ("weblancer",)
SOURCE_LABELS = {
    "freelance_ru": "Freelance.ru", "weblancer": "Weblancer", "fl_ru": "FL.ru",
    "habr_freelance": "Хабр Фриланс", "telegram_public": "Telegram — публичный пост",
}
SOURCE_BASE_URLS = {
    "freelance_ru": "https://freelance.ru/task?c%5B%5D=4",
    "habr_freelance": "https://freelance.habr.com/tasks",
    "fl_ru": "https://www.fl.ru/projects/",
    "telegram_public": "https://t.me/",
    "weblancer": "https://www.weblancer.net/freelance/",
}
SOURCE_HOSTS = {
    "freelance_ru": ("freelance.ru", "www.freelance.ru"),
    "habr_freelance": ("freelance.habr.com",),
    "fl_ru": ("www.fl.ru", "fl.ru"),
    "telegram_public": ("t.me",),
    "weblancer": ("www.weblancer.net", "weblancer.net"),
}
SEED_CATEGORY_URLS = (
    "https://www.fl.ru/projects/category/programmirovanie/",
    "https://www.fl.ru/projects/category/saity/",
    "https://www.fl.ru/projects/category/avtomatizaciya-biznesa/",
)
SEARCH_PREFIX = "https://freelance.ru/task?q="
SEARCH_TERMS = ("telegram", "python", "api", "автоматизация", "парсинг", "1с", "javascript", "react", "backend", "devops")
CHANNEL_PREFIX = "https://t.me/s/"
DEFAULT_CHANNELS = ("freelansim_ru", "digitaltender", "job_for_bots", "freelancetaverna")
CHANNEL_NAME = r"[A-Za-z][A-Za-z0-9_]{4,31}"
WEBLANCER_CATEGORIES = {
    "veb-programmirovanie": "Веб-программирование",
    "prikladnoe-po": "Прикладное ПО",
    "sistemnoe-administrirovanie": "Системное администрирование",
    "dizain-saitov": "Дизайн сайтов",
    "illyustratsii-i-risunki": "Иллюстрации и рисунки",
    "kopiraiting": "Копирайтинг",
}

# original cards: source -> (host without www., path pattern with the id as first group)
CARD_PATHS = {
    "fl_ru": ("fl.ru", r"/projects/(\d+)/[^/]+\.html"),
    "freelance_ru": ("freelance.ru", r"/task/view/(\d+)/?"),
    "habr_freelance": ("freelance.habr.com", r"/tasks/(\d+)/?"),
    "weblancer": ("weblancer.net", r"/freelance/[^/]+-\d+/[^/]+-(\d+)/?"),
}
# hosts whose card identity is a path prefix: host without www. -> pattern with the identity as first group
CANONICAL_PATHS = {
    "fl.ru": r"(/projects/\d+)(?:/.*)?",
    "freelance.ru": r"(/task/view/\d+)(?:/)?",
    "freelance.habr.com": r"(/tasks/\d+)(?:/)?",
}
PROJECT_LINKS = {
    "fl.ru": r"/projects/\d+",
    "freelance.ru": r"/task/view/\d+",
    "freelance.habr.com": r"/tasks/\d+",
    "t.me": r"/[A-Za-z][A-Za-z0-9_]{4,31}/\d+",
}
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("ref", "referrer", "fbclid", "gclid", "yclid")
LEGACY_URL_PREFIXES = {
    "fl_ru": "https://fl.ru/projects/",
    "freelance_ru": "https://freelance.ru/task/view/",
    "habr_freelance": "https://freelance.habr.com/tasks/",
}

CHALLENGE_TITLE = r"captcha|just a moment|access denied|доступ ограничен|проверка браузера"
SKIPPED_CARD_KIND = r"вакансия|конкурс"
HEADING_CATEGORIES = (("программ", "Программирование"), ("сайт", "Web development"), ("автоматизац", "Автоматизация"))
ORIGINAL_CARD_DATE = (
    r"Опубликован\s+(\d{2}\.\d{2}\.\d{4})\s+в\s+(\d{2}:\d{2})"
    r"(?:\s+Последнее изменение:\s+\d{2}\.\d{2}\.\d{4}\s+в\s+\d{2}:\d{2})?"
)
BUDGET_LINE = r"(?:💰\s*)?(?:бюджет|оплата|стоимость)\s*:"

# --- values ---------------------------------------------------------------------------------------------------

NO_FIXED_PRICE = r"договор|обсужда|не указан|по соглашению"
PRICE_PER_TIME = r"/\s*(?:ч(?:ас)?\b|h\b|hour|мес)|в\s+(?:час|месяц)|per\s+(?:hour|month)"
CURRENCIES = (
    (r"₽|\bруб\w*|\brub\b|\brur\b", "RUB"),
    (r"\$|\busd\b", "USD"),
    (r"€|\beur\b", "EUR"),
    (r"₴|\bгрн\b|\buah\b", "UAH"),
)
AMOUNT = r"\d+(?:[ .]\d{3})*(?:[,.]\d{1,2})?"
THOUSANDS_WORD = r"\b(?:тыс|k)\b"
RANGE_MARK = r"[–—-]|\bдо\b"
UPPER_BOUND = r"\b(?:до|up to)\b"
LOWER_BOUND = r"\b(?:от|from)\b"

LOCAL_OFFSET_HOURS = 3
NOW_WORDS = ("только что", "сейчас")
RELATIVE_TIME = r"(?:(\d+)\s+)?(секунд\w*|минут\w*|час\w*|день|дня|дней) назад"
DAY_WORDS = r"(сегодня|вчера)(?:\s+(?:в\s+)?(\d{1,2}:\d{2}))?"
PRECISE_RELATIVE = r"((?:\d+\s+(?:час\w*|минут\w*|секунд\w*)\s*)+)назад"
PRECISE_PART = r"(\d+)\s+(час\w*|минут\w*|секунд\w*)"
DAY_ROUNDED = r"\b(?:день|дня|дней) назад$"

STATUS_LABELS = (
    (r"(?:исполнитель|подрядчик)(?: уже)? (?:выбран|определен)|выбран исполнитель", "awarded"),
    (r"(?:(?:проект|заказ|задание) (?:уже )?)?закрыт[оа]?|завершен[оа]?", "closed"),
    (r"(?:отклики|заявки|предложения)(?: больше)? не принимаются|"
     r"прием (?:откликов|заявок|предложений) (?:закрыт|завершен|прекращен)", "not_accepting"),
)

POST_ADVERTISEMENT = r"\berid\b|#реклама\b|на правах рекламы|рекламный пост|промокод|купить рекламу|разместить рекламу"
POST_EDUCATION = (
    r"(?:записывай\w*|регистрируй\w*|приглашаем|регистрация на).{0,70}(?:курс|вебинар|интенсив)|"
    r"(?:бесплатный|обучающий)\s+(?:вебинар|курс)|(?:курс|вебинар|интенсив).{0,50}(?:скидк\w*|запись открыта)"
)
POST_FULL_TIME = (
    r"full[-\s]?time|полная занятость|в штат|на постоянную работу|5/2|40 часов в неделю|"
    r"трудоустройств\w*|зарплата|оклад|/\s*мес\b|в месяц|#вакансия\b"
)
POST_PROJECT_WORK = (
    r"разов\w*\s+(?:задач\w*|проект\w*|работ\w*)|проектн\w*\s+(?:занятость|работ\w*)|"
    r"сдельн\w*|фиксированн\w*\s+бюджет"
)

# --- drafts and messages --------------------------------------------------------------------------------------

DRAFT_KINDS = (
    ("telegram", ("telegram bot", "telegram-бот", "бот", "chatbot", "aiogram")),
    ("parsing", ("парсер", "парсинг", "scraping")),
    ("automation", ("n8n", "automation", "автоматизация")),
    ("api", ("api", "rest api", "интеграция", "fastapi", "webhook")),
    ("web", ("react", "javascript", "typescript", "node.js", "доработать сайт", "доработка сайта", "bug", "ошибка",
             "frontend", "backend", "fullstack")),
    ("infrastructure", ("docker", "linux", "vps")),
    ("sql", ("sql", "postgresql")),
)
DRAFT_DEFAULT = "python"
DRAFT_TOPICS = {
    "telegram": ("Telegram-ботами, Python и API-интеграциями", "сценарии бота и описание текущего проекта"),
    "python": ("Python, скриптами и обработкой данных", "пример входных данных, ожидаемый результат и текущий код, если он есть"),
    "api": ("REST API и интеграциями сервисов", "документацию API, пример запроса и описание нужного обмена данными"),
    "parsing": ("Python и сбором данных из публичных источников", "ссылки на публичные страницы и пример нужной таблицы"),
    "web": ("JavaScript, React и доработкой небольших веб-приложений", "ссылку на сайт, шаги воспроизведения проблемы и описание ожидаемого результата"),
    "automation": ("n8n, Python и автоматизацией бизнес-процессов", "схему процесса, список сервисов и пример результата"),
    "infrastructure": ("Docker, Linux и настройкой небольших серверных приложений", "описание окружения и ошибки без паролей и токенов"),
    "sql": ("SQL и PostgreSQL", "схему таблиц без персональных данных, текущий запрос и ожидаемый результат"),
}
DRAFT_OPENING = "Здравствуйте! Увидел вашу задачу «%s».\n"
DRAFT_CLARIFY = (
    "Готов посмотреть текущий проект и оценить объём, "
    "но сначала хотел бы уточнить используемый стек и характер доработок.\n\n"
    "Пришлите, пожалуйста, версии технологий, описание задачи и текущего проекта. "
    "После изучения смогу сказать, возьмусь ли за работу, и оценить срок и стоимость."
)
DRAFT_PARTIAL = (
    "Готов изучить задачу. Сначала хотел бы уточнить платформу, её версию, "
    "нужные изменения и ограничения текущего проекта.\n\n"
    "По этим данным оценю объём и смогу подтвердить возможность выполнения, срок и стоимость."
)
DRAFT_BODY = (
    "Готов посмотреть проект. Работаю с %s.\n\n"
    "Если пришлёте %s, оценю объём, срок и точную стоимость.\n\n"
    "Могу приступить в ближайшее время."
)
# complexity up to -> price from, price to
PRICE_BANDS = ((3, 5000, 10000), (5, 10000, 20000), (10, 20000, 30000))
PRICE_FLOOR, PRICE_CEILING = 5000, 30000
PRICE_TEXT = {
    "outside": "Уточнить объём: бюджет не пересекается с ориентиром для этой сложности (5 000–30 000 RUB).",
    "estimate": " — предварительный ориентир, после уточнения ТЗ.",
    "foreign": " Для бюджета в другой валюте курс не применялся.",
}
BUDGET_TEXT = {"no_currency": "валюта не указана", "none": "не указан", "up_to": "до ", "from": "от "}
MESSAGE_TEXT = {
    "fire": "🔥 БРАТЬ", "good": "🟡 ПОСМОТРЕТЬ",
    "date": "dd.MM.yyyy HH:mm 'МСК'", "day": "dd.MM.yyyy '(время не указано)'", "no_date": "неизвестно",
    "budget": "💰 Бюджет: ", "published": "🕒 Опубликовано: ", "source": "🌐 Источник: ",
    "id": "ID: ", "decision": " | Decision: ", "stack": "STACK_COMPATIBILITY: ",
    "age": "Возраст: %s ч", "no_age": "Возраст: неизвестен",
    "responses": "👥 Откликов: ", "no_responses": "неизвестно",
    "no_description": "Описание отсутствует.",
    "why": "Почему подходит:", "check": "Что проверить:", "risks": "Risk flags:", "no_risks": "нет",
    "complexity": "Сложность: %d/10 (предварительно)", "price": "Рекомендуемая цена:", "draft": "ГОТОВЫЙ ОТКЛИК:",
    "open": "🔗 Открыть заказ",
}
CAUTION_CODES = ("unknown_date", "foreign_budget", "above_target", "future_date")
MESSAGE_LIMIT_UTF16 = 4096

REDACTED_SECRET, REDACTED_URL, REDACTED_TOKEN = "[REDACTED]", "[REDACTED_URL]", "[REDACTED_TOKEN]"
REDACT_URL = r"https?://[^\s<>\"']+"
REDACT_TOKEN = r"\d{5,20}:[A-Za-z0-9_-]{20,100}"
REDACT_EMPTY = "No additional network details"

# --- fetch log and delivery outcomes --------------------------------------------------------------------------

TEMPORARY_STATUSES = (429, 500, 502, 503, 504)
RESTRICTED_STATUSES = (401, 403)
ROBOTS_ABSENT_STATUSES = (404, 410)
PAGE_CONTENT_TYPES = ("text/html", "application/xhtml+xml")
ROBOTS_CONTENT_TYPES = ("text/plain", "text/text")
MAX_PAGE_BYTES = 2 * 1024 * 1024
MAX_ROBOTS_BYTES = 262144
MAX_READ_SECONDS = 45
MAX_CRAWL_DELAY = 60.0
MIN_CRAWL_DELAY = 2.0
STOP_CODES = ("access_restricted", "challenge_page")
LAYOUT_ERROR_CODES = ("unrecognized_listing_layout", "all_cards_invalid", "unexpected_parse_error")
MAX_CARDS_PER_PAGE = 100
MAX_DETAIL_CARDS = 20
MAX_RETRY_SECONDS = 30
MAX_SEND_ATTEMPTS = 3
MAX_REPLY_BYTES = 65536

UPDATE_KINDS = ("message", "edited_message", "channel_post", "edited_channel_post", "business_message",
                "edited_business_message")
CHAT_TYPES = ("private", "group", "supergroup", "channel")
