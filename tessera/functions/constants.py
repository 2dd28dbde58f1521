"""Word lists, weights and limits that results depend on."""

from __future__ import annotations

# --- Fixed values: words ---
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "if", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their",
    "this", "to", "was", "what", "when", "where", "which", "who", "why", "with", "vs", "than", "about", "between", "latest", "current", "что", "как",
    "где", "когда", "кто", "или", "для", "это", "эта", "этот", "про", "из", "на", "по", "в", "во", "с", "со", "у", "о", "об", "ли", "чем", "какой",
    "какая", "какие", "каково", "есть", "был", "была", "были",
)
FRESH_MARKERS = (
    "today", "tomorrow", "yesterday", "this week", "next week", "last week", "this month", "next month", "last month",
    "this quarter", "next quarter", "last quarter", "current", "latest", "сегодня", "завтра", "вчера", "текущий", "последний",
)
COMPARISON_MARKERS = ("compare", "comparison", "difference", "versus", "vs", "contrast", "сравни", "сравнение", "разница", "отличается", "лучше", "хуже")
NEWS_PHRASES = (
    "what happened", "what happened in", "what is happening", "what's happening", "latest news", "news on", "news in", "updates on",
    "updates in", "latest developments", "последние новости", "какие новости", "что произошло", "что случилось", "что было", "события",
    "происшествия", "обновления",
)
RELATIVE_DAYS = {"today": 0, "tomorrow": 1, "yesterday": -1, "сегодня": 0, "завтра": 1, "вчера": -1}
MONTHS = (
    "jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept",
    "september", "oct", "october", "nov", "november", "dec", "december", "янв", "января", "фев", "февраля", "мар", "марта", "апр", "апреля", "мая",
    "июн", "июня", "июл", "июля", "авг", "августа", "сен", "сентября", "окт", "октября", "ноя", "ноября", "дек", "декабря",
)
ENTITY_JOINERS = ("of", "the", "and", "for", "de", "la", "и")
REGION_PREPOSITIONS = ("in", "for", "within", "в", "для", "по")
NO_ENTITIES = (
    "who", "what", "when", "where", "why", "how", "which", "кто", "что", "когда", "где", "почему", "как", "какой", "какая", "какие", "ceo", "cto",
    "cfo", "founder", "president", "chairman", "capital", "release", "released", "latest", "current",
)
NEGATION_TOKENS = ("not", "no", "never", "false", "incorrect")
MATCH_STOP_WORDS = (
    "a", "an", "the", "of", "is", "was", "were", "on", "in", "at", "for", "and",
)
SYNTHESIS_OPENINGS = (
    "как работает", "как работают", "как использовать", "как устроен", "как устроена", "как устроено", "что такое", "чем отличается",
    "чем отличаются", "в чем разница", "в чём разница", "объясни", "опиши", "сравни", "расскажи про", "расскажи о", "how does", "how do",
    "how to", "what is", "what are", "explain", "describe", "compare", "difference between", "differences between", "what's the difference",
    "what is the difference",
)
PROFILE_WORDS = {
    "news": ("новости", "новость", "news", "latest", "today", "breaking", "вчера", "сегодня", "прямо сейчас", "last hour"),
    "fresh": ("сегодня", "вчера", "прямо сейчас", "сейчас", "за сутки", "за день", "today", "yesterday", "last 24", "past 24"),
    "science": ("paper", "research", "study", "arxiv", "статья", "исследование", "научн", "pubmed", "journal", "abstract"),
    "qa": ("error", "exception", "traceback", "stack trace", "fails", "failing", "bug", "why does", "how fix", "segfault", "crash", "not working"),
    "repos": ("github", "gitlab", "repo", "repository", "package", "library", "module", "crate", "npm", "pip", "pypi", "docker image"),
    "tech": ("code", "error", "bug", "programming", "python", "javascript", "docker", "api", "github", "bash", "linux", "typescript", "npm", "kubectl", "terraform", "sql", "rust", "golang"),
    "release": ("when was", "release date", "released", "announcement", "version", "date", "launch", "changelog", "what is", "who is"),
}
INTENT_NEWS = ("news", "latest", "this week", "новости", "последние", "на этой неделе")
INTENT_SYNTHESIS = ("how", "why", "what are", "explain", "difference", "compare", "features", "overview", "чем отличается", "как работает", "объясни")
GUARDRAIL_PHRASES = ("недостаточно подтвержд", "insufficient evidence", "not enough supported")
AUTHOR_MARKERS = ("by:", "author:", "автор:")

# --- Fixed values: hosts and addresses ---
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "ref", "ref_src", "ref_url", "source")
HOST_MARKERS = {
    "official": (".gov", ".mil", ".gouv", "europa.eu", "who.int", "sec.gov", "irs.gov"),
    "academic": (".edu", "arxiv.org", "pubmed.ncbi.nlm.nih.gov", "nature.com", "science.org", "springer.com", "acm.org", "ieee.org", "sciencedirect.com", "doi.org"),
    "forum": ("reddit.com", "stackoverflow.com", "stackexchange.com", "quora.com", "forum.", "community.", "discuss.", "news.ycombinator.com"),
    "major_media": ("reuters.com", "apnews.com", "bbc.com", "nytimes.com", "theguardian.com", "bloomberg.com", "cnbc.com", "wsj.com", "ft.com", "cnn.com", "npr.org", "tass.ru", "interfax.ru", "kommersant.ru", "vedomosti.ru", "rbc.ru"),
    "vendor": ("docs.", "developer.", "support.", "help.", "learn.", "cloud.", "github.com"),
}
#: host or root, source prior, primary boost, spam penalty, verification bonus, domain type or nothing, label
ROOT_PRIORS = (
    ("python.org", 0.22, 0.22, 0.0, 0.24, "official", "official_root"),
    ("microsoft.com", 0.22, 0.22, 0.0, 0.22, "official", "official_root"),
    ("openai.com", 0.22, 0.22, 0.0, 0.22, "official", "official_root"),
    ("apple.com", 0.22, 0.22, 0.0, 0.22, "official", "official_root"),
    ("github.com", 0.08, 0.08, 0.0, 0.06, "vendor", "code_host"),
    ("medium.com", -0.06, -0.08, 0.05, -0.08, None, "ugc_platform"),
    ("linkedin.com", -0.04, -0.04, 0.03, -0.05, None, "social_profile"),
    ("youtube.com", -0.08, -0.10, 0.05, -0.10, None, "video_platform"),
    ("x.com", -0.10, -0.12, 0.08, -0.12, None, "social_feed"),
    ("news.ycombinator.com", -0.10, -0.14, 0.05, -0.12, None, "forum_discussion"),
    ("reddit.com", -0.12, -0.16, 0.06, -0.14, None, "forum_discussion"),
    ("wikipedia.org", 0.02, -0.04, 0.0, 0.0, None, "secondary_reference"),
)
#: host labels, then as above
LABEL_PRIORS = (
    (("investor", "ir", "newsroom", "press", "media"), 0.16, 0.18, 0.0, 0.18, "official", "official_subdomain"),
    (("blog",), 0.06, 0.10, 0.0, 0.10, None, "blog_subdomain"),
    (("docs", "developer", "support", "help", "learn", "cloud"), 0.10, 0.12, 0.0, 0.12, "vendor", "docs_subdomain"),
    (("community", "forum", "discuss"), -0.10, -0.14, 0.05, -0.12, "forum", "community_forum"),
)
OFFICIAL_SUFFIXES = (".gov", ".mil", ".gouv")
OFFICIAL_HOSTS = ("europa.eu", "who.int")
LOCAL_NEWS_HINTS = ("astana", "kaz", "tengri", "zakon", "inform", "kt.kz")
AUTHORITY_HOSTS = ("docs.python.org", "peps.python.org", "realpython.com", "wikipedia.org", "developer.mozilla.org", "docs.djangoproject.com", "docs.pytest.org", "docs.rust-lang.org", "docs.github.com", "docs.aws.amazon.com", "cloud.google.com", "learn.microsoft.com", "docs.microsoft.com")
BROWSER_FIRST = (".vc.ru",)
REPOSITORY_RESERVED = ("topics", "features", "explore", "marketplace", "pricing", "sponsors", "settings", "login", "signup", "collections", "trending")
SPAM_CUES = ("best ", "top ", "coupon", "deal", "promo", "discount", "affiliate", "alternatives", "vs ", "review", "reviews", "guide", "ultimate")
PRIMARY_CUES = ("official", "press release", "announcement", "earnings", "report", "filing", "documentation", "docs", "paper", "study", "whitepaper", "transcript", "официал", "пресс-релиз", "отчет", "документация", "исследование")
PRIMARY_PATHS = ("/announcement/", "/press", "/release", "/releases/", "/downloads/release/", "/whatsnew/")
RELEASE_CUES = ("announcement", "press", "release", "released", "downloads/release", "whatsnew", "/blog/")
FORUM_CUES = ("hacker news", "reddit", "forum", "comment")
RELATIONSHIP_CUES = (" agency ", " bureau ", " bureaus ", " department ", " component ", " administration ", " ministry ", " treasury ", " member of ", " part of ", " within ")

# --- Fixed values: weights and limits ---
PRIMARY_BASE = {"official": 0.9, "academic": 0.85, "vendor": 0.7, "major_media": 0.45, "forum": 0.15, "unknown": 0.4}
DOMAIN_PRIOR = {"official": 1.0, "academic": 0.95, "vendor": 0.75, "major_media": 0.7, "forum": 0.3, "unknown": 0.5}
VERIFICATION_BASE = {"official": 0.38, "academic": 0.34, "vendor": 0.18, "major_media": 0.08, "forum": -0.20, "unknown": 0.0}
SERP_WEIGHTS = {"domain": 0.22, "primary": 0.22, "freshness": 0.12, "entity": 0.16, "semantic": 0.12, "host_entity": 0.06, "time": 0.10, "spam": 0.25}
CHEAP_WEIGHTS = {"overlap": 0.30, "entity": 0.22, "dimension": 0.18, "focus": 0.15, "number": 0.07, "source": 0.08}
SEARCH_COST = {"shallow": 0.25, "deep": 1.0, "snippet_only": 0.10, "claim": 0.50}
PASSAGE_CHARS = 420
LEAST_BLOCK_CHARS = 60
CHEAP_THRESHOLD = 0.18
CHEAP_LIMIT = 12
STOP_CONFIDENCE = 0.75
TOP_PASSAGES = 25
SLATE_PER_URL, SLATE_PER_HOST, SLATE_TOTAL = 2, 4, 14
GATE_LIMIT = 20
MOST_ITERATIONS = 2

# --- Fixed values: what a composed answer says, in English and for Cyrillic questions ---
ANSWER_SAYS = {
    "answer": ("Answer", "Ответ"),
    "sources": ("Sources", "Источники"),
    "insufficient": ("Insufficient data", "Недостаточно данных"),
    "caveats": ("Caveats", "Оговорки"),
    "digest": ("Events from retrieved sources:", "События из источников:"),
    "no_evidence": ("Not enough claim-level evidence for a direct answer.", "Недостаточно подтверждённых утверждений для прямого ответа."),
    "coverage": ("coverage", "покрытие"),
    "open": ("insufficient evidence", "недостаточно данных"),
    "against": ("contradicted", "противоречит данным"),
    "gap_primary": ("needs primary-source evidence", "нужно подтверждение из первичного источника"),
    "gap_sources": ("needs {} independent sources", "нужно минимум {} независимых источника"),
    "gap_fresh": ("needs fresh dated evidence", "нужно свежее датированное подтверждение"),
    "few_sources": (" (supported by fewer than {} independent sources)", " (подтверждено менее чем {} независимыми источниками)"),
    "no_primary": (" (without a detected primary source)", " (без обнаруженного первичного источника)"),
    "not_fresh": (" (without fresh dated evidence)", " (без свежего датированного подтверждения)"),
}
CONTEXT_SAYS = {
    "source": "Источник [{}] — заголовок: {}\nURL: {}\nТекст:\n{}",
    "between": "\n\n---\n\n",
    "before": "Контекст (каждый блок помечен номером [n]; в ответе ссылка [n] означает только этот блок):\n\n",
    "question": "Вопрос: ",
    "after": "\n\nИзвлеки конкретные данные из контекста выше и ответь напрямую. Номера [n] в ответе должны соответствовать блокам с тем же [n].",
}
