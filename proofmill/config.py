"""Fixed values and thresholds of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# Recognition engines in the order in which ties are broken.
ENGINES = ("google", "azure", "ocrspace")

# Names that count as placeholders inside %..%, [..] or <..>.
PLACEHOLDERS = ("skin", "displayname", "username", "subscriber_firstname_capitalized", "first_name", "bonus_amount", "date")

# Languages written without spaces between words.
CJK = ("ja", "zh", "zh-hans", "zh-hant", "zh-cn", "zh-tw")

# First words of section names that are preferred, and that are not.
PREFERRED_NAMES = ("banner", "pic", "im", "popup")
AVOIDED_NAMES = ("news", "email", "letter", "subject")

# File kinds by extension.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif")
TEXT_EXTENSIONS = ("docx", "txt")

# Language codes that file names may hold.
LANGUAGES = (
    "zn", "ar", "az", "bg", "cs", "da", "de", "el", "en", "es", "et", "fa", "fi", "fr", "mk", "he", "hi", "hr", "hu", "hy", "id", "it", "ja", "ka",
    "kk", "ko", "lt", "lv", "nl", "no", "pl", "pt", "ro", "ru", "sk", "sl", "sr", "sv", "th", "tr", "uk", "ur", "vi", "zh", "cn", "kr", "il", "in",
    "gr", "se", "dk", "ua", "ee", "kz", "rs", "cz", "jp", "si",
)
COMPOSITE_LANGUAGES = ("zh-hans", "zh-hant", "pt-pt", "sr-latn", "az-latn", "kk-cyrl", "mk-mk")
LANGUAGE_ALIASES = {
    "cn": "zh", "zh": "zh", "zn": "zh", "kr": "ko", "il": "he", "in": "hi", "gr": "el", "se": "sv", "dk": "da", "ua": "uk", "ee": "et", "kz": "kk",
    "rs": "sr-latn", "sr": "sr-latn", "cz": "cs", "jp": "ja", "pt": "pt", "az": "az", "si": "sl",
}
# Fixed values.
#: File stems that are never a language; a site adds its own words.
NOT_LANGUAGES = (
    "logo", "icon", "btn", "mid", "bg", "bm", "bc", "wl", "vday", "promo", "email", "feb", "day", "valentine", "img", "done", "transl", "banner",
    "preview", "default", "thumb", "new", "top", "all", "web", "app",
)
# Fixed values.
#: Words that stand before a language code in a file name; a site adds its own.
VARIANT_PREFIXES = ("wl", "bc", "bm", "vday")

# Reasons that a later verdict never overwrites.
PROTECTED_REASONS = ("image_read_error", "missing_bbox", "crop_required")


@dataclass(frozen=True)
class Config:
    """Thresholds; a job passes its own to the operators."""

    similarity_chars: int = 2000
    similarity_shown: float = 0.85
    grey_low: float = 0.75
    grey_high: float = 0.99
    long_text_tokens: int = 50
    ambiguous_delta: float = 0.05
    single_delta: float = 999.0
    score_min: float = -0.8
    score_max: float = 6.0
    batch_size: int = 16
    max_crop_ratio: float = 0.95
    vector_threshold: float = 0.7
    vector_scales: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.4)
    vector_least: int = 8
    expiry_days: int = 7
    min_width: int = 1024
    min_height: int = 768
    partial_words: int = 3
    partial_confidence: float = 0.4


DEFAULT = Config()
