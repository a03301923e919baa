"""Invented listing pages, one per layout."""

FL = """<html><head><title>Заказы</title></head><body><h1>Заказы на программирование</h1>
<div id="project-item901" class="b-post"><h2><a href="/projects/901/bot-dlya-zayavok.html">Бот для приёма заявок на Python</a></h2>
<div class="b-post__price">15 000 – 20 000 ₽</div><div class="b-post__body"><div class="b-post__txt">Нужно добавить экспорт заявок в CSV и подключить REST API склада, доступ к коду есть, срок 4 дня.</div></div>
<div class="b-post__foot"><span class="b-post__bold">Заказ</span><span class="text-gray-opacity-4">2 часа 10 минут назад</span>
<a data-id="fl-view-count-href" href="#">3 ответа</a></div></div>
<div id="project-item902" class="b-post topprjpay"><h2><a href="https://www.fl.ru/projects/902/landing.html">Лендинг</a></h2>
<div class="b-post__price">по договорённости</div><div class="b-post__foot"><span class="b-post__bold">Заказ</span><span class="text-gray-opacity-4">вчера</span>
<span><i title="Количество ответов"></i> 12</span></div><div data-id="qa-order-status">Исполнитель выбран</div></div>
<div id="project-item903"><h2><a href="/projects/903/v.html">Вакансия</a></h2><div class="b-post__foot"><span class="b-post__bold">Вакансия</span></div></div>
<div id="project-item904"><h2><a href="https://evil.example/projects/904/x.html">Чужой адрес</a></h2></div>
<a href="/projects/category/programmirovanie/page-2/">2</a><a href="/projects/category/programmirovanie/page-3/">3</a>
</body></html>"""

FREELANCE = """<html><body><div class="task-feed-list">
<article class="task-card"><a class="task-card__title-link" href="/task/view/41?from=feed">Парсер каталога</a>
<div class="task-card__desc">Собрать данные и сохранить в xlsx</div><div class="task-card__meta-rows">Срок: 5 дней</div>
<div class="task-card__chips"><span class="task-chip">Веб</span><span class="task-chip">Python</span></div>
<div class="task-card__budget">от 7 000 руб.</div>
<div class="task-card__foot"><span class="task-card__foot-item" title="21.09.2026 14:30"><i class="fa-clock-o"></i> 30 минут</span>
<span class="task-card__foot-item"><i class="fa-comments"></i> 4</span><span class="task-card__foot-item"><i class="fa-eye"></i> 1 204</span>
<span class="task-card__foot-item">Опыт: 2 года</span></div></article>
<article class="task-card task-card--premium"><a class="task-card__title-link" href="/task/view/42">Премиум</a></article>
<article class="task-card"><a class="task-card__title-link" href="/task/view/43/">Закрытая задача на React</a><span class="task-badge">Проект закрыт</span>
<div class="task-card__foot"><span class="task-card__foot-item" title="сегодня"><i class="fa-clock-o"></i></span></div></article>
<article class="task-card"><a class="task-card__title-link" href="https://other.example/task/view/44">Не тот хост</a></article>
<article class="task-card"><p>без ссылки</p></article>
</div><a href="/task?c%5B0%5D=4&page=2" data-page="1">2</a></body></html>"""

HABR = """<html><body><article class="task"><div class="task__title"><a href="/tasks/71">Сервис на FastAPI</a></div>
<div class="task__description">Интеграция с внешним API</div><div class="task__price">30 000 руб. за проект</div>
<span class="params__responses">9 откликов</span><ul class="task__tags"><li>python</li><li>fastapi</li></ul>
<time datetime="2026-09-21T13:00:00+03:00">час назад</time></article>
<article class="task"><div class="task__title"><a href="/tasks/72/">Вёрстка</a></div><time datetime="2026-09-21">сегодня</time></article>
<article class="task"><div class="task__title"><a href="/users/1">не задача</a></div></article></body></html>"""

WEBLANCER = """<html><body><article><div><h2><a href="/freelance/prikladnoe-po-5/uchet-sklada-311/">Учёт склада</a></h2>
<span class="whitespace-nowrap">150 <!-- --> $</span></div><p>Доработка программы, бюджет 999 руб не указывать</p>
<span>20.09.2026</span><span>1 024 просмотра</span><span>6 заявок</span><a href="/freelance/delphi/">Delphi</a></article>
<article><div><h2><a href="javascript:void(0)">Сломанная</a></h2></div></article>
<article><div><h2><a href="/freelance/novaya-kategoriya-9/zadacha-312">Другая</a></h2></div></article></body></html>"""

POSTS = """<html><body>
<div class="tgme_widget_message" data-post="Freelansim_ru/11"><div class="tgme_widget_message_text">#python #бот<br>Доработать telegram-бот на aiogram<br>Бюджет: 12 000 ₽<br><a href="https://t.me/someone">контакт</a> <a href="https://freelance.ru/task/view/41/?utm_source=tg">заказ</a></div>
<a class="tgme_widget_message_date"><time datetime="2026-09-21T10:15:00+00:00"></time></a></div>
<div class="tgme_widget_message" data-post="freelansim_ru/12"><div class="tgme_widget_message_text">Приглашаем на бесплатный курс по Python</div></div>
<div class="tgme_widget_message" data-post="freelansim_ru/13"><div class="tgme_widget_message_forwarded_from">из канала</div><div class="tgme_widget_message_text">Ищем в штат backend-разработчика, зарплата высокая</div>
<a class="tgme_widget_message_date"><time datetime="2026-09-21T10:15:00"></time></a></div>
<div class="tgme_widget_message" data-post="freelansim_ru/14"><i>фото</i></div>
<div class="tgme_widget_message" data-post="otherchannel/15"><div class="tgme_widget_message_text">Чужой канал</div></div>
</body></html>"""

CHALLENGE = "<html><head><title>Just a moment...</title></head><body><form id='challenge-form'></form></body></html>"
MALFORMED = "<html><head><title>ok</title></head><body><p>ничего"

CARD = """<html><body><div id="projectp901" class="x"><div class="text-10">brief: отклики не принимаются</div></div>
<div class="text-10 opacity-50">Опубликован 21.09.2026 в 13:20 Последнее изменение: 21.09.2026 в 13:40</div>
<div class="wrap"%s><button id="reply_offer"%s>Откликнуться</button></div><p>%s</p></body></html>"""
