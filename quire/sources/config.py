"""Settings, with the limits that hold by default, and checks of a request."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

FORMATS = ("txt", "epub")
LANGUAGES = ("zh-CN", "zh-TW", "zh-Hant")


@dataclass(frozen=True)
class Config:
    """Defaults."""

    search_limit: int = 30
    search_filter: bool = True
    max_jobs: int = 3
    concurrency: int = 50
    most_concurrency: int = 100
    min_interval: int = 200
    max_interval: int = 400
    max_attempts: int = 3
    retry_min_interval: int = 2000
    retry_max_interval: int = 4000
    toc_concurrency: int = 5
    most_bytes: int = 10 * 1024 * 1024
    txt_encoding: str = "UTF-8"
    extension: str = "epub"
    language: str = "zh-CN"
    preserve_chapter_cache: bool = False


def load_config(path: str | None = None) -> Config:
    """Defaults, with what a TOML file (flat or in sections) sets; unknown keys are ignored."""
    if path is None:
        return Config()
    with open(path, "rb") as f:
        read = tomllib.load(f)
    flat = {k: v for k, v in read.items() if not isinstance(v, dict)}
    for section in read.values():
        if isinstance(section, dict):
            flat |= section
    return Config(**{f.name: flat[f.name] for f in fields(Config) if f.name in flat})


def checked_request(url: str, extension: str = "", language: str = "", concurrency: int = 0, config: Config | None = None) -> dict:
    """A request in full; ValueError for a blank url, an unknown format or language, or a concurrency out of range."""
    from ..functions.lang import canonical

    config = config or Config()
    if not url.strip():
        raise ValueError("url is blank")
    extension = (extension or config.extension).lower()
    if extension not in FORMATS:
        raise ValueError(f"format {extension}")
    language = canonical(language or config.language)
    if language not in LANGUAGES:
        raise ValueError(f"language {language}")
    if concurrency and not 1 <= concurrency <= config.most_concurrency:
        raise ValueError(f"concurrency {concurrency}")
    return {"url": url.strip(), "extension": extension, "language": language, "concurrency": concurrency or config.concurrency}
