"""Constants of the engine; each operator takes them as defaults."""

import unicodedata
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    hits: int = 20
    rrf_k: int = 60
    secondary_weight: float = 0.01
    secondary_chunks: int = 2
    rerank_top: int = 10
    promotion: float = 1.0
    cutoff: float = 1.6
    strong_with_literal: float = 1.45
    strong_meaning_only: float = 1.50
    strong_gap: float = 0.08
    weak_gap: float = 0.15
    weak_shown: int = 3
    tie_window: float = 0.0006
    duplicate_jaccard: float = 0.5
    half_life_s: float = 1_209_600.0
    cold_start: int = 20
    session_gap_s: int = 1800
    slot_hours: int = 4
    list_size: int = 5
    slot_events: int = 2
    slot_share: float = 0.4
    chunk_words: int = 100
    chunk_overlap: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    retention_s: int = 30 * 86400
    recent_s: int = 7 * 86400


DEFAULTS = Settings()

# Fixed values.
EVENT_WEIGHTS = {"file_opened": 3.0, "recommendation_clicked": 3.0, "file_revealed": 2.0, "result_clicked": 1.0}
SHOWN_WEIGHT, SHOWN_RESULTS = 0.15, 5
PERSONAL_MIX = {"frequency": 0.35, "recency": 0.15, "type": 0.15, "topic": 0.2, "time": 0.15}
TYPE_ALIASES = {"documents": "document", "images": "image", "videos": "video", "emails": "email", "photo": "image", "photos": "image", "picture": "image", "pictures": "image", "spreadsheets": "spreadsheet", "excel": "spreadsheet", "presentations": "presentation", "slides": "presentation", "powerpoint": "presentation", "doc": "word", "music": "audio", "songs": "audio", "movie": "video", "movies": "video"}
# File formats by extension.
DOCUMENTS = "pdf docx txt md".split()
SHEETS = "csv tsv xlsx xlsm".split()
SLIDES = ["pptx"]
CODE = "py js ts tsx jsx java c cpp h hpp cs go rs rb php swift kt css json xml yaml yml toml ini cfg sh bat ps1 sql rtf".split()
WEB = "html htm".split()
OLD = "odt ods odp epub eml msg doc xls ppt".split()
AUDIO = "mp3 wav m4a flac ogg aiff aif wma aac opus".split()
IMAGES = "jpg jpeg png gif bmp webp avif heic heif tif tiff".split()
VIDEOS = "mp4 mov m4v mkv webm avi 3gp wmv mts m2ts mpg mpeg".split()
ARCHIVES = "zip 7z rar tar gz bz2 xz iso cab".split()
SAME_FORMAT = (("jpg", "jpeg"), ("tif", "tiff"), ("heic", "heif"), ("mpg", "mpeg"), ("mts", "m2ts"))
TYPE_GROUPS = {
    "document": tuple(DOCUMENTS + SHEETS + SLIDES + CODE + WEB + OLD),
    "image": tuple(IMAGES),
    "audio": tuple(AUDIO),
    "video": tuple(VIDEOS),
    "email": ("eml", "msg"),
    "spreadsheet": tuple(SHEETS),
    "presentation": tuple(SLIDES),
    "code": tuple(CODE),
    "word": ("doc", "docx"),
    "text": ("txt", "md"),
    **{ext: pair for pair in SAME_FORMAT for ext in pair},
}
FILLER = "find search show open get look up me my i the a an of for to in on at about please can you could would want need file files note notes document documents where what which did do does is are was were have has that this those these it with and or thing stuff something wrote write put saved kept from by into our your his her their".split()
NAME_NOISE = "a an the my me of for to in on and or with about open show find get search look up please".split()
NAME_GENERIC = "file files document documents note notes folder photo photos picture pictures image images photograph photographs pic pics snap snaps shot shots".split()
QUESTION_WORDS = "how what when where why which who whom whose did does do is are was were can could should would will explain find show tell".split()
STOP_WORDS = "the a an and or but of in on at to for with about from by as into my me i we our you your it its this that these those there here is are was were be been have has had not no so than then up out".split()


def _plain(letter: str) -> str:
    """The letter of a Latin one with accents; nothing for any other character."""
    base = unicodedata.normalize("NFD", letter)
    return base[0] if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]) else ""


_LATIN = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if _plain(c) and c == c.lower()]
#: Lower-case Latin letters with accents and what they fold to; combining marks stand at the end and fold to nothing.
ACCENTED = "".join(_LATIN) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(map(_plain, _LATIN))
KINDS = {"view": "result_clicked", "click": "file_opened", "purchase": "recommendation_clicked", "error": "file_revealed", "signup": "query"}
EXTENSIONS = ("md", "txt", "pdf", "docx", "csv", "py", "jpg", "mp3", "mp4", "html")
NOW = 1706659200.0
