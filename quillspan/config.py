"""Parameters and feature switches, read from an INI file or taken from the defaults."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields, replace

FEATURES = (
    "GL-first-lines", "GL-last-lines", "GL-frequent", "GL-most-frequent", "GL-most-frequent-code", "GL-possible-english-word", "GL-short-lang-name", "GL-is-english", "GL-multi-word-name",
    "W-prev", "W-close", "W-closest", "W-frequent", "W-after", "W-close-after", "W-closest-after", "W-frequent-after",
    "L-in-line", "G-in-line", "T-in-line", "M-in-line", "L-LMw", "L-LMc", "L-LMm", "L-CR-LMw", "L-CR-LMc",
)


@dataclass(frozen=True)
class Settings:
    window_size: int = 25
    after_window_size: int = 25
    close_window_size: int = 2
    after_close_window_size: int = 2
    wide_window_size: int = 500
    wide_min_names: int = 20
    wide_min_lines: int = 2000
    word_n: int = 1
    morpheme_n: int = 2
    character_n: int = 3
    web_char_n: int = 3
    web_word_n: int = 1
    morpheme_delimiter: str = r"[\s\-\=\+]+"
    frequent_threshold: int = 6
    after_frequent_threshold: int = 6
    article_frequent_threshold: int = 20
    short_name_size: int = 3
    case_sensitive: bool = False
    single_mention: bool = False
    code_only_models: bool = False
    strict_tags: bool = False
    fold_case: bool = False
    normalize_gold: bool = False
    features: frozenset[str] = field(default_factory=lambda: frozenset(FEATURES))

    def on(self, feature: str) -> bool:
        return feature in self.features


#: INI key -> (field, conversion)
_KEYS = {
    "window-size": "window_size", "after-window-size": "after_window_size", "close-window-size": "close_window_size", "after-close-window-size": "after_close_window_size",
    "word-n-gram-size": "word_n", "morpheme-n-gram-size": "morpheme_n", "character-n-gram-size": "character_n", 
    "morpheme-delimiter": "morpheme_delimiter", "frequent-mention-threshold": "frequent_threshold", "after-frequent-mention-threshold": "after_frequent_threshold",
    "article-frequent-mention-threshold": "article_frequent_threshold", "short-name-size": "short_name_size", "single-longest-mention": "single_mention",
}
#: Keys that begin with the name of a model source are told by their ends.
_ENDS = {"-char-size": "web_char_n", "-word-size": "web_word_n", "-lms": "code_only_models"}


def settings_from(path: str | None) -> tuple[Settings, dict[str, str]]:
    """Settings and the ``[locations]`` of an INI file; defaults where it is silent or absent.

    Any ``mention-capitalization`` of lower, upper or title amounts to comparing without case, as both sides are
    changed alike; any other value compares names (lower case) with the words as they stand.
    """
    if path is None:
        return Settings(), {}
    ini = configparser.ConfigParser()
    ini.optionxform = str
    if not ini.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    out = Settings()
    kinds = {f.name: f.type for f in fields(Settings)}
    for key, value in ini.items("parameters") if ini.has_section("parameters") else []:
        name = _KEYS.get(key) or next((v for k, v in _ENDS.items() if key.endswith(k)), None)
        if name:
            kind = kinds[name]
            out = replace(out, **{name: int(value) if kind == "int" else value.strip() == "yes" if kind == "bool" else value})
        elif key == "mention-capitalization":
            out = replace(out, case_sensitive=value not in ("lower", "upper", "title"))
    if ini.has_section("features"):
        out = replace(out, features=frozenset(k for k, v in ini.items("features") if v.strip() == "yes"))
    return out, dict(ini.items("locations")) if ini.has_section("locations") else {}
