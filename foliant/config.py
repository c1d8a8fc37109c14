"""Settings and fixed values of the full-text engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

INDEX_VERSION = 5

# What each size profile allows per document
PROFILES = {
    "normal": {"max_chars": 1_000_000, "max_file_size": 200 * 1024 * 1024},
    "long": {"max_chars": 20_000_000, "max_file_size": 256 * 1024 * 1024},
}

# Field bits of a posting
MASK = {"name": 1, "annotation": 2, "tags": 4, "folders": 8, "content": 16, "url": 32}
# Weights of fields in the score; content has a saturating term frequency instead
WEIGHTS = {"name": 6.0, "annotation": 3.5, "tags": 4.5, "folders": 2.0, "url": 0.8}
K1 = 1.2
SNIPPET_CHARS = 260
TITLE_BOOST, PHRASE_BOOST = 1.8, 1.25
PARTIAL_FLOOR = 0.35

# Extension groups
EXT_GROUPS = {
    "image": "png jpg jpeg gif webp bmp tif tiff heic avif svg psd ai".split(),
    "pdf": ["pdf"],
    "word": "docx doc rtf odt wps".split(),
    "excel": "xlsx xls csv tsv ods et".split(),
    "ppt": "pptx ppt odp dps".split(),
    "text": "txt md markdown log tex bib srt vtt json xml yaml yml py js ts r sh sql java c cpp html htm".split(),
    "ebook": "epub mobi azw3 djvu".split(),
    "media": "mp4 mov avi mkv webm mp3 wav flac m4a ogg".split(),
    "design": "sketch fig xd blend obj fbx stl".split(),
    "archive": "zip rar 7z tar gz".split(),
}
# Names of extraction methods in reports
METHOD_LABELS = {"pdf": "PDF", "ooxml": "Office", "odf": "ODF", "epub": "ePub", "rtf": "RTF", "utf8": "文本", "legacy-binary": "旧版Office", "skip": "仅元数据"}
# Names of the fields that a hit lists
FIELD_LABELS = {"name": "标题", "annotation": "注释", "tags": "标签", "folders": "文件夹", "url": "链接", "content": "正文"}


def group_of(ext: str | None) -> str:
    """The group of an extension; ``other`` for unknown, empty and null ones."""
    ext = (ext or "").lower()
    return next((g for g, members in EXT_GROUPS.items() if ext in members), "other")


@dataclass(frozen=True)
class Settings:
    profile: str = "normal"
    max_chars: int = PROFILES["normal"]["max_chars"]
    max_file_size: int = PROFILES["normal"]["max_file_size"]
    include_trashed: bool = False
    incremental: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    def with_profile(self, name: str) -> Settings:
        """The settings under a size profile; an unknown name means ``normal``."""
        name = name if name in PROFILES else "normal"
        return replace(self, profile=name, **PROFILES[name])

    def signature(self) -> str:
        """What an index covers; one built under another signature is out of date."""
        return f"{self.max_chars}|{self.max_file_size}|{int(self.include_trashed)}"
