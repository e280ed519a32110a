"""Word lists and tables the analyses depend on.

Everything here is a parameter default: each operator takes its own list.
"""

# Phrases that mark a comment as naming misinformation.
MISINFO_PHRASES = (
    "fake news", "bullshit", "misinfo", "clickbait", "unreliable", "propoganda",
)

# The longer phrase set, applied to cleaned text.
MISINFO_PHRASES_WIDE = (
    "fake news", "bullshit", "misinfo", "clickbait", "unreliable", "propoganda",
    "propaganda", "fraud", "deceptive", "fabricated", "deep state", "wake up", "truth about",
)

# Communities kept by ingest.
COMMUNITIES = ("news", "worldnews")

# Topic number -> topic name of the published topic tables.
TOPIC_NAMES = {
    0: "russia&ukraine",
    1: "social media",
    2: "current events",
    3: "tv shows",
    4: "covid",
    5: "foriegn relations",
    6: "emerging tech",
    7: "demographic info",
}

# Topics left out of title clustering.
UNCLUSTERED_TOPICS = ("demographic info", "tv shows")

# Title terms used as 0/1 features, topic by topic; repeats are part of the list.
TITLE_TERMS = (
    "ukraine", "russian", "russia", "us", "war", "putin", "president", "eu", "china", "ukrainian",
    "covid", "vaccine", "new", "elon", "news", "musk", "hong", "twitter", "kong", "court",
    "police", "market", "shooting", "man", "analysis", "report", "school", "black", "us", "industry",
    "episode", "mtv", "splitsvilla", "live", "show", "th", "full", "getting", "june", "already",
    "world", "us", "covid", "global", "queen", "top", "need", "pandemic", "water", "watch",
    "us", "biden", "new", "iran", "power", "china", "climate", "korea", "president", "money",
    "crypto", "covid", "people", "bitcoin", "keep", "japan", "variant", "usa", "cases", "johnson",
    "age", "family", "worth", "height", "net", "biography", "indian", "wiki", "actor", "born",
)

# The terms of each topic, ten by ten: the words by which a fitted topic is recognised.
TOPIC_SEEDS = {name: list(TITLE_TERMS[10 * k : 10 * k + 10]) for k, name in TOPIC_NAMES.items()}

# Extra stop words for normalised (letters-only) title tokens.
TITLE_STOP_WORDS = (
    "reuters", "في", "از", "ap", "says", "bbcworld", "amp", "rt", "apentertainment", "la", "user",
    "deleted", "क", "di", "در", "آهنگ", "de", "el", "en", "دانلود", "به", "म",
)

# Extra stop words for plain whitespace title tokens.
RAW_TITLE_STOP_WORDS = (
    "@reuters:", "–", "&amp;", "@ap:", "rt", ":", "از", "آهنگ", "دانلود", "در", "به", "جدید",
    "@apentertainment:", "|", "के", "में", "و", "في", "من", "@bbcworld:", "de", "la", "di", "की",
    "से", "bio", "many", "know", "age", "says", "one", "net", "user]", "[deleted", "look",
)

# Spellings of a source that count as one.
SOURCE_ALIASES = {"reuter": "reuters", "youtu": "youtube"}

# Sources that mean the post has no outside link.
EXCLUDED_SOURCES = ("reddit",)

# Day names by Spark's dayofweek number.
DAY_NAMES = {
    1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday",
    5: "Thursday", 6: "Friday", 7: "Saturday",
}

# The two article labels, in index order.
NOT_PERCEIVED = "no perceived misinfo"
PERCEIVED = "perceived misinfo"
ARTICLE_LABELS = (NOT_PERCEIVED, PERCEIVED)

# Daily measures of the two external tables.
EPIDEMIOLOGY_MEASURES = ("new_confirmed", "new_deceased")
VACCINATION_MEASURES = (
    "new_persons_vaccinated", "new_persons_fully_vaccinated", "new_vaccine_doses_administered",
)

# Published constants of the valence method (Hutto & Gilbert 2014).
VALENCE_ALPHA = 15.0
NEGATION_SCALAR = -0.74
BOOSTER_STEP = 0.293
CAPITALS_STEP = 0.733
EXCLAMATION_STEP = 0.292
QUESTION_STEP = 0.18
QUESTION_TOP = 0.96
LOOKBACK_DAMPING = (1.0, 0.95, 0.9)

# Words that turn the valence of a following word around.
NEGATORS = (
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "rarely", "seldom", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt", "despite",
)

# Words that strengthen, and words that weaken, a following word.
STRENGTHENERS = (
    "absolutely", "amazingly", "completely", "considerably", "decidedly", "deeply", "enormously",
    "entirely", "especially", "exceptionally", "extremely", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably",
    "utterly", "very",
)
WEAKENERS = (
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sorta",
)
