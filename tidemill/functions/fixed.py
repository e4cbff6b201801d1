"""Fixed values that results depend on: patterns, words and tables, in their given order."""

#: Fixed value: texts that greet, advertise or come from bots.
BOT = r"капч|нажмите на|добро пожаловать в чат|в течение 120 секунд|у меня есть информация по данной теме|если ответ неполный|онлайн обмен валюты|промокод|подключай интернет|бот-помощник"
#: Fixed value: what makes a text a question.
QUESTION = r"\?|(?:^|\s)(?:подскаж|как |где |сколько |нужно ли|можно ли|есть ли|кто[- ]?нибудь|принимают ли)"
#: Fixed value: what makes a reply useful.
USEFUL = r"(?:смог|смогла|получил|получила|получилось|открыли|не открыли|дают|не дают|нужен|не нужен|нужно|не нужно|принимают|не принимают|лимит|комис|штраф|действует|можно|нельзя|работает|не работает|\b\d+\b|r\$|реал|дней|месяц|час|минут|внж|rnm|cpf|спф|апостил|справк|банк|карта|pix|багаж|билет|консуль|карторио|такси|uber|автобус)"
#: Fixed value: replies that say nothing.
NOISE = r"^(?:спасибо|благодарю|ясно|понял|поняла|ок|угу|ага)$"

#: Subjects by pattern, the first that matches, and the category of each.
SUBJECTS = (
    ("banking_access", "finance", r"\b(?:банк|карт[аеу]|сч[её]т|pix|wise|itau|nubank|bradesco|bb|banco do brasil|inter|c6|santander|99)\b"),
    ("document_requirements", "documents", r"\b(?:внж|rnm|cpf|спф|апостил|справк|карторио|консуль|свидетельств|перевод)\b"),
    ("tourist_stay_rules", "visa", r"\b(?:виза|безвиз|90\s*дн|180\s*дн|турист|гражданств|натурализац|бежен)\b"),
    ("flight_rules", "transport", r"\b(?:багаж|рейс|пересад|turkish|ethiopian|qatar|royal air maroc|билет|авиак)\b"),
    ("transport_rules", "transport", r"\b(?:такси|uber|автобус|метро|поезд|машин|аренда авто)\b"),
    ("housing_rules", "housing", r"\b(?:квартир|аренд|кондо|condo|condominio|quinto andar|жиль)\b"),
    ("food_grocery", "food", r"\b(?:супермаркет|магазин|продукт|еда|кухн|ресторан|кафе|доставк|ifood|rappi|mercado|feira|хлеб|молок|мяс|рыб|фрукт|овощ|готови|рецепт|pão de açúcar|assaí|carrefour|extra|atacadão)\b"),
    ("shopping", "shopping", r"\b(?:магазин|шоппинг|торгов|mall|shopping|купить|покупк|одежд|обувь|техник|электрон|aliexpress|mercado livre|shopee|amazon)\b"),
)
#: Subject and category of texts that match none.
OTHER_SUBJECT, OTHER_CATEGORY = "general_practical_info", "other"

#: Tags by pattern, all that match.
TAGS = (
    (r"\b(?:банк|nubank|itau|bradesco|inter|c6|santander)\b", "банк"),
    (r"\bpix\b", "pix"),
    (r"\bwise\b", "wise"),
    (r"\b(?:карт[аеу]|картой|карты)\b", "карта"),
    (r"\b(?:cpf|спф)\b", "cpf"),
    (r"\b(?:внж|rnm|crnm)\b", "внж"),
    (r"\b(?:апостил\w*)\b", "апостиль"),
    (r"\b(?:справк\w*)\b", "справка"),
    (r"\b(?:консуль\w*)\b", "консульство"),
    (r"\b(?:карторио)\b", "карторио"),
    (r"\b(?:паспорт\w*)\b", "паспорт"),
    (r"\b(?:виза|визу|визой|визы)\b", "виза"),
    (r"\b(?:гражданств\w*|натурализац\w*)\b", "гражданство"),
    (r"\b(?:рейс\w*|перел[её]т\w*)\b", "рейс"),
    (r"\b(?:билет\w*)\b", "билет"),
    (r"\b(?:багаж\w*)\b", "багаж"),
    (r"\b(?:пересад\w*)\b", "пересадка"),
    (r"\b(?:такси|uber|убер)\b", "такси"),
    (r"\b(?:автобус\w*|метро)\b", "транспорт"),
    (r"\b(?:аренд\w*|квартир\w*|жиль\w*)\b", "жильё"),
    (r"\b(?:сим|vivo|tim|claro)\b", "связь"),
    (r"\b(?:супермаркет\w*|mercado|feira)\b", "супермаркет"),
    (r"\b(?:pão de açúcar|assaí|carrefour|extra|atacadão)\b", "супермаркет"),
    (r"\b(?:ресторан\w*|кафе|ifood|rappi)\b", "еда"),
    (r"\b(?:продукт\w*|еда|готовк\w*)\b", "продукты"),
    (r"\b(?:mercado livre|shopee|aliexpress|amazon)\b", "маркетплейс"),
)

#: Weight of a stored answer's confidence in search.
CONFIDENCE_WEIGHT = {"high": 1.2, "medium": 1.0, "low": 0.7}
#: Seconds of each step of the penalty ladder; past the last, the day is over.
PENALTY_LADDER = (60, 300, 1800, 6000)
#: Cyrillic letters in Latin, for addresses.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

#: Tags of listing templates, of sections by heading, and of all others.
LISTING_TAGS = {"see": "Travel", "do": "Travel", "eat": "Food", "drink": "Food", "sleep": "Accommodation", "buy": "Shopping", "listing": "Travel", "marker": "Travel"}
SECTION_TAGS = {
    "understand": "Culture", "history": "Culture", "regions": "Travel", "cities": "Travel", "other destinations": "Travel", "get in": "Bureaucracy", "by plane": "Transport", "by train": "Transport",
    "by bus": "Transport", "by car": "Transport", "by boat": "Transport", "get around": "Transport", "talk": "Language", "see": "Travel", "do": "Travel", "buy": "Shopping", "money": "Finance",
    "costs": "Finance", "eat": "Food", "drink": "Food", "sleep": "Accommodation", "learn": "Education", "work": "Work", "stay safe": "Safety", "stay healthy": "Health", "respect": "Culture",
    "connect": "Telecom", "cope": "Bureaucracy", "go next": "Travel",
}
OTHER_TAG = "Travel"
#: Fixed value: what the hashed ids of wiki rows begin with.
WIKI_SEED = "wikivoyage"
