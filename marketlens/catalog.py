"""Rule data: the catalogue, patterns and word lists the operators take as parameters.

Everything here is data, not logic. The values below are fixed values: results are only
right when they are exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelRule:
    """How a family picks its model: the earliest match in the title, or the first rule that hits."""

    rules: tuple[tuple[str, str], ...]
    default: str
    earliest: bool = False


@dataclass(frozen=True)
class Entry:
    """One catalogue row; its rank is its position in the catalogue."""

    id: str
    special: bool
    family: str
    model: str
    memory: str
    shell: str


@dataclass(frozen=True)
class TitleRules:
    families: tuple[tuple[str, str, int], ...]
    bare_family: tuple[str, str] | None
    models: dict[str, ModelRule]
    aliases: dict[str, tuple[str, str | None]]
    family_of_label: dict[str, str]
    sub_models: dict[str, str]
    patterns: dict[str, str]
    editions: tuple[tuple[str, str], ...]
    colors: tuple[tuple[str, str], ...]
    family_titles: dict[str, str]
    catalogue: tuple[Entry, ...]
    product: str
    label_prefix: str
    method: str
    unit_tb: int = 1024
    default_title: str = ""
    extra: dict = field(default_factory=dict)


# --- fixed values: console catalogue (id, special, family, model, memory, shell) ---------
CONSOLE_CATALOGUE = tuple(
    Entry(*row)
    for row in (
        ("11111", False, "Original/OG", "Base", "8 GB", "Nero"),
        ("21112", True, "Original/OG", "Base", "8 GB", "Verde"),
        ("21113", True, "Original/OG", "Base", "8 GB", "Crystal"),
        ("12111", False, "360", "Base/Core", "0 GB", "Bianco"),
        ("12121", False, "360", "Base/Core", "256 MB", "Bianco"),
        ("12131", False, "360", "Base/Core", "20 GB", "Bianco"),
        ("12141", False, "360", "Base/Core", "60 GB", "Bianco"),
        ("12151", False, "360", "Base/Core", "120 GB", "Bianco"),
        ("12161", False, "360", "Base/Core", "250 GB", "Bianco"),
        ("12231", False, "360", "Premium/Pro", "20 GB", "Bianco"),
        ("12241", False, "360", "Premium/Pro", "60 GB", "Bianco"),
        ("12352", False, "360", "Elite", "120 GB", "Nero"),
        ("12362", False, "360", "Elite", "250 GB", "Nero"),
        ("12411", False, "360", "Arcade", "0 GB", "Bianco"),
        ("12421", False, "360", "Arcade", "256 MB", "Bianco"),
        ("12431", False, "360", "Arcade", "20 GB", "Bianco"),
        ("12441", False, "360", "Arcade", "60 GB", "Bianco"),
        ("12451", False, "360", "Arcade", "120 GB", "Bianco"),
        ("12461", False, "360", "Arcade", "250 GB", "Bianco"),
        ("12512", False, "360", "Slim/S", "4 GB", "Nero"),
        ("12522", False, "360", "Slim/S", "250 GB", "Nero"),
        ("12532", False, "360", "Slim/S", "320 GB", "Nero"),
        ("12542", False, "360", "Slim/S", "500 GB", "Nero"),
        ("12612", False, "360", "E", "4 GB", "Nero"),
        ("12622", False, "360", "E", "250 GB", "Nero"),
        ("12632", False, "360", "E", "320 GB", "Nero"),
        ("12642", False, "360", "E", "500 GB", "Nero"),
        ("22231", True, "360", "Premium/Pro", "20 GB", "Halo 3"),
        ("22232", True, "360", "Premium/Pro", "20 GB", "The Simpsons Movie"),
        ("22233", True, "360", "Premium/Pro", "20 GB", "Gears of War 2"),
        ("22351", True, "360", "Elite", "120 GB", "Resident Evil 5 Red"),
        ("22362", True, "360", "Elite", "250 GB", "Modern Warfare 2"),
        ("22431", True, "360", "Slim/S", "320 GB", "Halo: Reach"),
        ("22432", True, "360", "Slim/S", "320 GB", "Call of Duty: Modern Warfare 3"),
        ("22433", True, "360", "Slim/S", "320 GB", "Gears of War 3"),
        ("22434", True, "360", "Slim/S", "320 GB", "Star Wars Kinect"),
        ("22435", True, "360", "Slim/S", "320 GB", "Halo 4"),
        ("22436", True, "360", "Slim/S", "320 GB", "Xbox Live 10th Anniversary"),
        ("13111", False, "One", "Originale/Base", "500 GB", "Nero"),
        ("13112", False, "One", "Originale/Base", "500 GB", "Bianco"),
        ("13121", False, "One", "Originale/Base", "1 T", "Nero"),
        ("13212", False, "One", "S", "500 GB", "Bianco"),
        ("13222", False, "One", "S", "1 T", "Bianco"),
        ("13232", False, "One", "S", "2 T", "Bianco"),
        ("13321", False, "One", "X", "1 T", "Nero"),
        ("23111", True, "One", "Originale/Base", "1 T", "Call of Duty"),
        ("23112", True, "One", "Originale/Base", "1 T", "Forza Blu LE"),
        ("23113", True, "One", "Originale/Base", "1 T", "Halo 5"),
        ("23114", True, "One", "Originale/Base", "1 T", "Elite"),
        ("23115", True, "One", "Originale/Base", "1 T", "Verde Militare"),
        ("23116", True, "One", "Originale/Base", "1 T", "Minecraft"),
        ("23117", True, "One", "Originale/Base", "1 T", "Viola"),
        ("23211", True, "One", "S", "500 GB", "Blu Profondo"),
        ("23222", True, "One", "S", "1 T", "All-Digital Binaca"),
        ("23233", True, "One", "S", "2 T", "Gears of War 5"),
        ("23311", True, "One", "X", "1 T", "CyberPunk"),
        ("23312", True, "One", "X", "1 T", "Gears of War 5"),
        ("23313", True, "One", "X", "1 T", "Gold Rush"),
        ("23314", True, "One", "X", "1 T", "Hyperspace"),
        ("23315", True, "One", "X", "1 T", "Robot White"),
        ("14111", False, "Serie", "S", "512 GB", "Bianca"),
        ("14121", False, "Serie", "S", "1 T", "Bianca"),
        ("14122", False, "Serie", "S", "1 T", "Carbon Black"),
        ("14221", False, "Serie", "X", "1 T", "Nera"),
        ("14222", False, "Serie", "X", "1 T", "All-Digital Bianca"),
        ("14233", False, "Serie", "X", "2 T", "Galaxy Black"),
        ("24221", True, "Serie", "X", "1 T", "Halo Infinite"),
    )
)

# --- fixed values: title patterns ---------------------------------------------------------
CONSOLE_PATTERNS = {
    "storage": r"(\d[\d.]*)\s*(GB|TB|T)\b",
    "storage_mb": r"\b(256)\s*MB\b|\bmemory\s*unit\b|\bflash\b",
    "limited": r"\b(limited|ltd|collector(?:'s)?|launch|day\s*one|project\s+scorpio|anniversary|halo\w*|forza\w*|gears\w*|starfield|cyberpunk)\b",
    "special": r"\b(special|editione\s+speciale|edizione\s+speciale|anniversary|commemorative|commemorativa|galaxy\s+black|20th\s+anniversary|elite\s+series)\b",
    "bundle": r"\b(bundle|pack|con\s+gioco|with\s+game|inclus[oa]|include|bundle\s+edition)\b",
    "premium": r"\b(elite|project\s+scorpio|2\s*tb|2tb|galaxy\s+black)\b",
    "digital": r"\b(digital|all\s*\-?\s*digital|senza\s+lettore|no\s+disc|edizione\s+digitale)\b",
    "noise": r"\b(microsoft|console|wireless|controller|controllere?|inkl?|incl\.?|con|senza|colore)\b",
    "kinect": r"\bkinect\b",
    "no_kinect": r"\bno\s+kinect\b|\bsenza\s+kinect\b|\(no\s+kinect\)",
}
CONSOLE_FAMILIES = (
    ("series", r"\bxbox\s+series(?:\s*[xs])?\b|\bseries\s*[xs]\b|\bserie\s*[xs]\b", 4),
    ("one", r"\bxbox\s+one(?:\s*[xs])?\b|\bone\s*[xs]\b|\bone\b", 3),
    ("360", r"\bxbox\s*360\b|\bxbox360\b|\b360\s*[se]?\b", 2),
    ("original", r"\boriginal\b|\bog\b|\bxbox\s+classic\b", 1),
)
CONSOLE_MODELS = {
    "series": ModelRule(
        (("X", r"\bseries\s*x\b|\bserie\s+x\b"), ("S", r"\bseries\s*s\b|\bserie\s+s\b")), "S", True
    ),
    "one": ModelRule((("X", r"\bone\s*x\b"), ("S", r"\bone\s*s\b")), "Originale/Base", True),
    "360": ModelRule(
        (
            ("E", r"\b(?:xbox\s*)?360\s*\"?e\"?\b"),
            ("Slim/S", r"\b360\s*slim\b|\bslim\b|\b360[Ss]\b"),
            ("Elite", r"\belite\b"),
            ("Arcade", r"\barcade\b"),
            ("Premium/Pro", r"\b(premium|pro)\b"),
            ("Base/Core", r"\b(core|base)\b"),
        ),
        "Base/Core",
    ),
    "original": ModelRule((), "Base"),
}
CONSOLE_EDITIONS = (
    ("Call Of Duty", r"\bcall\s+of\s+duty\b|\bmodern\s+warfare\b"),
    ("Minecraft", r"\bminecraft\b"),
    ("Halo", r"\bhalo\w*\b"),
    ("Forza", r"\bforza\w*\b"),
    ("Gears", r"\bgears\w*\b"),
    ("Cyberpunk", r"\bcyber\s*punk\b|\bcyberpunk\b"),
    ("Star Wars Kinect", r"\bstar\s+wars\b"),
    ("Resident Evil 5", r"\bresident\s+evil\s*5\b"),
    ("The Simpsons Movie", r"\bsimpsons\b"),
    ("Xbox Live 10th Anniversary", r"\bxbox\s+live\s+10th\s+anniversary\b|\b10th\s+anniversary\b"),
    ("Gold Rush", r"\bgold\s+rush\b"),
    ("Hyperspace", r"\bhyperspace\b"),
    ("Robot White", r"\brobot\s+white\b"),
    ("Galaxy Black", r"\bgalaxy\s+black\b"),
    ("Carbon Black", r"\bcarbon\s+black\b"),
    ("Verde Militare", r"\bverde\s+militare\b"),
    ("Blu Profondo", r"\bblu\s+profondo\b"),
    ("Crystal", r"\bcrystal\b"),
)
CONSOLE_COLORS = (
    ("Nero", r"\bnero\b|\bnera\b|\bblack\b"),
    ("Bianco", r"\bbianco\b|\bbianca\b|\bwhite\b"),
    ("Verde", r"\bverde\b|\bgreen\b"),
    ("Crystal", r"\bcrystal\b"),
    ("Blu", r"\bblu\b|\bblue\b"),
    ("Rosso", r"\brosso\b|\bred\b"),
    ("Viola", r"\bviola\b|\bpurple\b"),
    ("Oro", r"\bgold\b|\boro\b"),
)
CONSOLE_ALIASES = {
    "series-x": ("series", "X"),
    "series-s": ("series", "S"),
    "one-x": ("one", "X"),
    "one-s": ("one", "S"),
    "one": ("one", "Originale/Base"),
    "360": ("360", None),
    "original": ("original", "Base"),
    "series": ("series", None),
    "original/og": ("original", None),
    "og": ("original", None),
    "serie": ("series", None),
}
CONSOLE_FAMILY_TITLES = {
    "series": "Xbox Series",
    "one": "Xbox One",
    "360": "Xbox 360",
    "original": "Xbox Original/OG",
}
CONSOLE_SUB_MODELS = {
    "base": "Base",
    "base/core": "Base",
    "originale/base": "Base",
    "slim/s": "S",
    "s": "S",
    "x": "X",
    "e": "E",
    "elite": "Elite",
    "arcade": "Arcade",
    "premium/pro": "Premium/Pro",
}

CONSOLE_RULES = TitleRules(
    families=CONSOLE_FAMILIES,
    bare_family=(r"\bxbox\b", "original"),
    models=CONSOLE_MODELS,
    aliases=CONSOLE_ALIASES,
    family_of_label={"original/og": "original", "360": "360", "one": "one", "serie": "series"},
    sub_models=CONSOLE_SUB_MODELS,
    patterns=CONSOLE_PATTERNS,
    editions=CONSOLE_EDITIONS,
    colors=CONSOLE_COLORS,
    family_titles=CONSOLE_FAMILY_TITLES,
    catalogue=CONSOLE_CATALOGUE,
    product="XBOX",
    label_prefix="Xbox",
    method="rules:v3:bibbia-2026-06-05",
    default_title="Xbox",
)

# --- fixed values: sources, conditions, packaging ------------------------------------------
SOURCE_PREFIX = {
    "cex": 1, "gamelife": 2, "gamepeople": 3, "gameshock": 4,
    "rebuy": 5, "jollyrogerbay": 6, "subito": 7, "ebay": 8,
}
OTHER_PREFIX = 9
CONDITION_RANK = {"Nuovo": 0, "Usato": 1}
SEPARATE_SOURCES = ("subito", "ebay")
SOURCE_CONDITION = {"cex": "Usato", "rebuy": "Usato", "gamepeople": "Nuovo"}
URL_KEYED_SOURCES = ("cex", "gameshock", "gamepeople", "jollyrogerbay")
MARKER_SOURCE = "gameshock"
VARIANT_SOURCE = "rebuy"
USED_MARKER = r"\busata?\b|\bused\b"
GRADE_SUFFIX = r"\[(Eccellente|Molto buono|Buono|Accettabile)\]\s*$"
CONSOLE_NAME_FAMILY = r"\bxbox\s*(?:series\s*[xs]|one(?:\s*[xs])?|360|original)\b"
CONSOLE_NAME_HINT = r"\bconsole\b|\b\d+\s*(?:gb|tb)\b|\ball-digital\b|\bkinect\b|\bedition\b|\bedizione\b"
PACK_NOT = r"\bnon[-\s]*imballat"
PACK_DISCOUNTED = r"\bscontat"
BLOCKED_URLS = (
    "https://www.gamelife.it/hwxx0023-rog-ally-xbox-512gb-bianco",
    "https://www.gamelife.it/hwxx0022-rog-ally-xbox-1tb-nero",
)
CATEGORY_OF_FAMILY = {
    "series": "Xbox Series", "series-x": "Xbox Series", "series-s": "Xbox Series",
    "one": "Xbox One", "one-x": "Xbox One", "one-s": "Xbox One",
    "360": "Xbox 360", "original": "Xbox Original",
}
FAMILY_GROUPS = {
    "Original": ("original",), "360": ("360",),
    "One": ("one", "one-s", "one-x"), "Series": ("series", "series-x", "series-s"),
}
STORE_SOURCES = ("cex", "gamelife", "gamepeople", "gameshock", "rebuy")
STORE_ORDER = ("gamelife", "gamepeople", "gameshock", "rebuy", "cex")
ASK_SOURCES = ("cex", "rebuy", "gameshock")
BID_SOURCES = ("subito", "ebay")

# --- fixed values: valuation and alerts ----------------------------------------------------
VAT_RATE = 0.22
SOURCE_WEIGHTS = {"cex": 0.45, "ebay": 0.35, "subito": 0.20}
ALERT_RETENTION_DAYS = 90
ALERT_CAP = 50
PRICE_FLOORS = {
    "series": 50.0, "series-x": 80.0, "series-s": 50.0, "one": 30.0, "one-x": 40.0,
    "one-s": 35.0, "360": 10.0, "original": 8.0, "other": 8.0,
}
DEFAULT_FLOOR = 8.0
FAMILY_LABELS = {
    "series-x": "Xbox Series X", "series-s": "Xbox Series S", "one-x": "Xbox One X",
    "one-s": "Xbox One S", "one": "Xbox One", "360": "Xbox 360", "original": "Xbox Original",
}

# --- fixed values: model scoring -----------------------------------------------------------
APPROVED = ("approved", "approved_auto", "approved_manual")
PENDING = ("pending", "pending_review")
CASCADE_THRESHOLD = 80
OBJECT_TYPES = ("console", "bundle", "accessory", "game", "parts", "empty_box", "service", "unknown")
NOT_CONSOLE = ("accessory", "game", "parts", "empty_box", "service")
PRICE_SIGNALS = ("compatible", "suspicious_low", "suspicious_high", "missing", "irrelevant")
PRICE_BOUNDS = {
    "series-x": (80.0, 900.0), "series-s": (50.0, 450.0), "one-x": (40.0, 400.0),
    "one-s": (35.0, 300.0), "one-base": (30.0, 250.0), "360": (10.0, 250.0),
    "original": (8.0, 250.0),
}
SEGMENTS = ("base", "premium", "unknown")
EDITION_CLASSES = ("bundle", "limited", "special", "standard")

# --- fixed values: text filters ------------------------------------------------------------
STOP_TOKENS = ("xbox", "console", "con", "the", "and", "per", "for", "edition")
RELEVANT_TOKEN = r"\bx[\s\-]*box\b"
RELEVANT_SERIES = r"\b(serie|series)\s*[sx]\b"
RELEVANT_CONTEXT = r"\b(console|microsoft|gamepass|controller|joystick|videogioc)\b"
TOPIC_ANY = ("xbox",)
TOPIC_MODEL = ("series x", "series s", "serie x", "serie s")
TOPIC_CONTEXT = ("console", "microsoft")
SOLD_MARKERS = (
    "non più disponibile",
    "annuncio non più disponibile",
    "questo annuncio non è più disponibile",
)
SOLD_HOME = "https://www.subito.it"
PARTS = r"ricamb[io]|per pezzi|for parts|non funzionante|rott[ao]|difettosa|malfunzionante|cannibalizz"
SOLD_BLOCK = (
    r"\b(controller|gamepad|joypad|joystick|\bpad\b|headset|\bcavo\b|\bcavi\b|alimentator[ei]"
    r"|caricatore|\bhdmi\b|hard\s*disk|\bhdd\b|\bssd\b|game\s*pass|xbox\s*live|\bgold\b"
    r"|abbonamento|\bdlc\b|\bcodice\b|voucher|gift\s*card|\bfifa\d*|\bnba\b|\bcall\s+of\b"
    r"|minecraft|battlefield|\bassassin|\bgta\b|\bwwe\b|\bufc\b|\bmortal\b)\b"
)
SOLD_ALLOW = (
    r"\b(xbox\s+series\s+[xs]\b|xbox\s+one\s+[xs]\b|xbox\s+one\b|xbox\s+360\b"
    r"|xbox\s+original\b|microsoft\s+xbox\b|console\b)\b"
)
SECRETS = (
    r"\b\d{6,}:[A-Za-z0-9_-]{20,}\b",
    r"sk-[A-Za-z0-9-]{16,}",
    r"(?i)(token|api[_-]?key|password)\s*[=:]\s*\S+",
    r"(?i)bearer\s+[A-Za-z0-9._\-]+",
)
EMBEDDED_JSON = r"(?s)<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
CONDITION_CODES = {"10": "Nuovo", "20": "Usato", "30": "Usato", "40": "Usato", "50": "Usato"}
REGIONS = (
    ("Lombardia", "lombardia"), ("Lazio", "lazio"), ("Campania", "campania"),
    ("Sicilia", "sicilia"), ("Veneto", "veneto"), ("Piemonte", "piemonte"),
    ("Emilia-Romagna", "emilia-romagna"), ("Toscana", "toscana"), ("Puglia", "puglia"),
    ("Calabria", "calabria"), ("Sardegna", "sardegna"), ("Liguria", "liguria"),
    ("Abruzzo", "abruzzo"), ("Marche", "marche"),
    ("Friuli-Venezia Giulia", "friuli-venezia-giulia"),
    ("Trentino-Alto Adige", "trentino-alto-adige"), ("Umbria", "umbria"),
    ("Basilicata", "basilicata"), ("Molise", "molise"), ("Valle d'Aosta", "valle-d-aosta"),
)

# --- fixed values: job monitoring ----------------------------------------------------------
JOB_STATUS = ("ok", "warn", "error")
LOG_FATAL = (
    r"traceback \(most recent call last\)|exit code [1-9]|another job is already running"
    r"|unhandledexception|\bfatal\b|\bcritical\b|killed|\boom\b|segmentation fault|modulenotfounderror"
)
LOG_ISSUE = (
    r"\[error\]|\[warning\]|\berrore\b|\bwarn(ing)?\b|\bfailed\b|429|too many requests|timeout|attenzione"
)
# A word of every alternative above, in lower case: a line without any of them cannot fit.
LOG_FATAL_WORDS = (
    "traceback (most recent call last)", "exit code ", "another job is already running", "unhandledexception", "fatal", "critical",
    "killed", "oom", "segmentation fault", "modulenotfounderror",
)
LOG_ISSUE_WORDS = ("[error]", "[warning]", "errore", "warn", "failed", "429", "too many requests", "timeout", "attenzione")
LOG_RUN_FAILED = r"##\[error\]|exit code [1-9]|\bfailed\b|\berror:\b"
LOG_STARTED = r"job\s+\S+\s+started at\s+(\S+)"
LOG_SEGMENT = r"\] job |\[backup\] start"

# --- fixed values: parsed product view -----------------------------------------------------
VIEW_FAMILY = {"series": "Serie", "one": "One", "360": "360", "original": "Original"}
VIEW_COLORS = (
    # colour, pattern, patterns that switch it off
    ("Rosso", r"\brosso\b|\bred\b", ("gears",)),
    ("Blu", r"\bblu\b|\bblue\b", ()),
    ("Verde", r"\bverde\b|\bgreen\b", ("minecraft",)),
    ("Bianco", r"\bbianc[oa]\b|\bwhite\b", ("gears",)),
    ("Nero", r"\bnero\b|\bblack\b", ()),
    ("Grigio", r"\bgrigio\b|\bgrey\b|\bgray\b", ("gears", "gold")),
    ("Cristallo", r"\bcristallo\b|\bcrystal\b", ()),
    ("Viola", r"\bviola\b|\bpurple\b", ()),
    ("Oro", r"\boro\b|\bgold\b", ("gold",)),
)
VIEW_SWITCHES = {"gears": r"\bgears\b", "minecraft": r"\bminecraft\b", "gold": r"\bgold\s*rush\b"}
VIEW_EDITIONS = (
    ("Call Of Duty", r"\b(?:call\s+of\s+duty|cod|mw2|mw3|advanced\s+warfare|black\s+ops)\b"),
    ("Halo", r"\bhalo\b"),
    ("Gears Of War", r"\bgears\b"),
    ("Forza", r"\bforza(?:\s+motorsport|\s*horizon)?\b"),
    ("Minecraft", r"\bminecraft\b"),
    ("Cyberpunk 2077", r"\bcyberpunk\b"),
    ("Battlefield", r"\bbattlefield\b"),
    ("Star Wars", r"\bstar\s+wars|r2-?d2\b"),
    ("Fortnite", r"\bfortnite\b"),
    ("Project Scorpio", r"\bproject\s+scorpio\b"),
    ("Resident Evil", r"\bresident\s+evil|re5\b"),
    ("The Simpsons", r"\bsimpsons?\b"),
    ("Mountain Dew", r"\bmountain\s+dew\b"),
    ("Taco Bell", r"\btaco\s+bell\b"),
    ("Hyperspace", r"\bhyperspace\b"),
    ("Deep Blue", r"\bdeep\s+blue\b"),
    ("Robot White", r"\brobot\s+white\b"),
    ("Day One", r"\bday\s+one\b"),
    ("Conker", r"\bconker\b"),
    ("Skeleton", r"\bskeleton\b"),
    ("Kasumi-Chan", r"\bkasumi\b"),
    ("Panzer Dragoon", r"\bpanzer\s+dragoon\b"),
    ("Gold Rush", r"\bgold\s*rush\b"),
    ("Diablo", r"\bdiablo\b"),
    ("Celebrity", r"\bcelebrity\b"),
)
VIEW_BUNDLE = r"(?:bundle|\+\s*.+gioco|\+\s*.+game)"
VIEW_SEGMENTS = {
    "series": (("X", r"\bseries\s*x\b|\bserie\s+x\b"), ("S", r"\bseries\s*s\b|\bserie\s+s\b")),
    "one": (("X", r"\bone\s*x\b"), ("S", r"\bone\s*s\b")),
    "360": (
        ("E", r"\b(?:xbox\s*)?360\s*\"?[eE]\"?\b"),
        ("S", r"\b360\s*slim\b|\bslim\b|\b360s\b"),
        ("Elite", r"\belite\b"),
    ),
}
STRIP_PREFIX = {
    "series": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+Series\s*",
    "series-x": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+Series\s+X\s*",
    "series-s": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+Series\s+S\s*",
    "one": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+One\s*",
    "one-x": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+One\s+X\s*",
    "one-s": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+One\s+S\s*",
    "360": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+(360\s*|250\s*GB\s*)",
    "original": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s*",
}

# --- fixed values: manual fixes by display id (id, storage, colour, edition) ---------------
OVERRIDES = (
    (1122, None, None, "Digital"), (1123, None, None, "Digital"), (1124, None, None, "Digital"),
    (1154, None, None, "Halo Infinite"), (1155, None, None, "Halo Infinite"),
    (1156, None, None, "Halo Infinite"), (2021, None, "Bianco", None), (2022, None, "Bianco", None),
    (2029, None, None, "Anthem"), (2030, None, None, "Anthem"), (2037, None, None, "Digital"),
    (2038, None, None, "Digital"), (2039, None, "Bianco", None), (2040, None, "Bianco", None),
    (2041, None, "Bianco", None), (2042, None, "Bianco", None), (2049, None, "Nero", None),
    (2050, None, "Nero", None), (2065, "512 GB", "Bianco", None), (2066, "512 GB", "Bianco", None),
    (2067, "512 GB", None, None), (2068, "512 GB", None, None), (2069, "512 GB", None, None),
    (2070, "512 GB", None, None), (2071, "512 GB", "Bianco", None), (2072, "512 GB", "Bianco", None),
    (2076, "1 TB", "Nero", None), (2077, "1 TB", "Nero", None), (2078, "1 TB", None, None),
    (2079, "1 TB", None, None), (2080, "1 TB", None, None), (2081, "1 TB", None, "Diablo IV"),
    (2082, "1 TB", None, None), (2083, "1 TB", None, None), (3002, None, "Bianco", None),
    (3003, None, None, "Diablo IV"), (3004, None, "Nero", None), (3032, None, "Nero", None),
    (4018, None, "Bianco", None), (4019, "1 TB", "Bianco", None), (4031, "512 GB", "Bianco", None),
    (4032, "1 TB", "Nero", None),
)
