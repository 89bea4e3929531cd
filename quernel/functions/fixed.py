"""Word lists, patterns and texts that results depend on."""

# Words that say nothing about the equipment, in count questions.
COUNT_STOP_WORDS = (
    "сколько", "всего", "какие", "какой", "какая", "какое", "есть", "где",
    "они", "она", "оно", "нас", "наш", "нашей", "нашем", "штук", "шт",
    "как", "что", "это", "для", "или", "при", "того", "которые", "который",
    "находится", "находятся", "установлен", "установлены", "установлено",
    "перечисли", "покажи", "список", "выведи", "нужно", "надо", "можно",
    "имеется", "числится", "числятся", "стоит", "стоят", "штуки",
)

# The same for the row search.
SEARCH_STOP_WORDS = (
    "какие", "какой", "какая", "какое", "есть", "где", "они", "она", "оно", "он",
    "как", "что", "это", "для", "или", "при", "того", "которые", "который",
    "находится", "находятся", "установлен", "установлены", "можно", "нужно",
)

# Routing patterns, in the order in which they are tried.
ROUTES = {
    "replacement": r"\b(замен\w+|устарел\w+|просроч\w+|истек\w+|менять|заменить|срок\w*\s+служб\w+|ресурс\w*)\b",
    "count": r"\b(скольк\w*|посчита\w+|подсчита\w+|общее\s+количество|суммарн\w+|кол-?во)\b",
    "location": r"\b(где\s+(стои\w+|наход\w+|установ\w+|размещ\w+)|в\s+как\w+\s+(помещени\w+|здани\w+|корпус\w*)|по\s+как\w+\s+адрес\w*|адрес\w*\s+установк\w+)\b",
    "docs": r"\b(как\s+(обслуж\w+|подключ\w+|настро\w+|монтир\w+|эксплуат\w+)|характеристик\w+|парамет\w+|инструкц\w+|руководств\w+|регламент\w*|техническ\w+\s+обслуживани\w+|\bТО\b|схем\w+|номинал\w+)\b",
}
DEFAULT_ROUTE = "general"

# When the register itself is asked.
FACT_COUNT = r"\b(скольк\w*|посчита\w+|подсчита\w+|общее\s+количество|суммарн\w+|кол-?во|количество)\b"
FACT_REPLACEMENT = r"\b(замен\w+|устарел\w+|просроч\w+|истек\w+|менять|заменить|срок\w*\s+служб\w+|ресурс)\b"
YEAR_WORD = r"\d{4}|году?|год"

# Article numbers.  Repeats are possessive: nothing after them has to match, and groups that
# may give back recurse once for each repeat.
ARTICLE = r"\b[A-Za-zА-Яа-я]{1,6}[\s\-]?\d{1,4}(?:[\-–.]?[A-Za-zА-Яа-я0-9]{1,6})*+(?:\s\d{1,4}(?:[\-–.]?[A-Za-zА-Яа-я0-9]{1,6})*+)*+"
LATIN, CYRILLIC = "abcekmoptxh", "авсекмортхн"
MIN_ARTICLE = 4
LIKE_ARTICLE = 0.86

# Procedures, in questions and in texts.
PROCEDURAL_QUESTION = r"\b(как\s+(обслуж\w+|провер\w+|эксплуат\w+|монтир\w+|подключ\w+|настро\w+|устано\w+)|обслуживани\w+|регламент\w*|порядок\s+\w+|периодичн\w+|что\s+делать)\b"
PROCEDURAL_TEXT = r"(техническо\w+\s+обслуживани\w+|перечень\s+работ|периодичн\w+|порядок\s+(технического|проведения|работ)|меры\s+безопасности|\d+\s*(мес|месяц\w*|год\w*|лет)\b|осмотр\s+\w+)"

# Refusals, and marks of invented answers.
REFUSAL = r"(нет информаци|не найден|не нашл|отсутству|не содержит|не указан|не могу|обратит\w+\s+к\s+специалист)"
CHECK_REFUSAL = r"нет информации|не найден|не нашл|отсутству|не содержит|не указан|не могу|обратит\w+ к специалист"
INVENTED = r"смаж|смазк|окислен|протрит|обезжир"

# Cautions.
NO_DOCS = "Ответ дан без опоры на документацию — проверьте сведения сами."
LOW_RELEVANCE = "Подходящих мест в документации не нашлось — ответ может относиться к другому оборудованию. Сверьтесь с источниками."
FEW_DOCS = "Ответ собран по одному-двум фрагментам. Сверьтесь с источниками."

# Register headers.
HEADER_MARK = "Позиция"
COLUMNS = {
    "position": "Позиция",
    "name": "Наименование и техническая характеристика",
    "model": "Тип, марка, модель, модификация, характеристики",
    "serial": "Заводской номер, артикул",
    "address": "Адрес расположения здания (помещения) НКО",
    "qty_raw": "Количество",
    "unit": "Ед. изм.",
    "replace_year_raw": "Нормативный срок замены",
    "place": "Место установки: объект, помещение, координаты",
    "commissioned": "Год ввода в эксплуатацию",
}
NO_ADDRESS = "не указан"

# Files.
SUFFIXES = (".pdf", ".docx", ".xlsx", ".csv")
TABLE_SUFFIXES = (".xlsx", ".csv")
EXCLUDED_FOLDERS = ("chroma", "user_uploads")
MAX_UPLOAD = 200 * 1024 * 1024
MIN_USEFUL = 200

# Facts from the register.
COUNTED = "Точный подсчёт по реестру для «%s»: %s позиций, суммарно %s %s"
BY_ADDRESS = "\nПо адресам:\n"
DUE = "Точный подсчёт по реестру: %s позиций с нормативным сроком замены до %s включительно\n"
DUE_ITEM = "  - %s (замена %s) — %s"
DUE_MORE = "\n  ... и ещё %s"

# What a question's context is made of.
SAID = "Пользователь: %s\nТы: %s"
HISTORY = "ПРЕДЫДУЩИЕ ВОПРОСЫ (для понимания отсылок вроде «а сколько их»):\n"
FACTS = "ТОЧНЫЕ ДАННЫЕ ИЗ РЕЕСТРА (посчитаны по всей базе, используй эти числа как достоверные):\n"
FRAGMENT = "[Источник %s: %s]\n%s"
FRAGMENTS = "ФРАГМЕНТЫ ДОКУМЕНТАЦИИ:\n\n"
EMPTY_CONTEXT = "КОНТЕКСТ ПУСТ: подходящих документов не найдено."
QUESTION = "ВОПРОС: "
BETWEEN = "\n\n---\n\n"

# What becomes of a file.
KNOWN_FILE = "Этот документ уже добавлен"
KNOWN_AS = " — «%s»"
WRONG_KIND = "Неподдерживаемый формат: %s"
TOO_LARGE = "Файл больше %d МБ"
NO_TEXT = "пустой текст после парсинга"
NO_READER = "нет чтения формата %s"
