"""What an export does: options with defaults, seven recipes, six presets of a destination's limits."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .operators.transform import Options


@dataclass(frozen=True)
class Limits:
    """0 is no limit."""

    label: str = "no limit"
    parts: int = 0
    words_per_part: int = 0
    tokens_per_part: int = 0
    total_words: int = 0
    total_tokens: int = 0
    megabytes_per_part: int = 0


@dataclass(frozen=True)
class Chunking:
    """mode: single, maxChars, maxTokens, maxWords, perNote, perFolder."""

    mode: str = "maxWords"
    max_chars: int = 1_000_000
    max_tokens: int = 100_000
    max_words: int = 450_000
    overlap: int = 150
    level: int = 2
    repeat_header: bool = True

    def limit_tokens(self) -> int:
        """1.35 tokens a word, 3.6 characters a token; 0 without a limit."""
        return {"maxChars": round(self.max_chars / 3.6), "maxTokens": self.max_tokens, "maxWords": -(-self.max_words * 27 // 20)}.get(self.mode, 0)


#: id: the limits of a destination and how to chunk for it.
PRESETS = {
    "none": (Limits(), Chunking("single")),
    "notebook-free": (Limits("notebook (free)", parts=50, words_per_part=500_000, megabytes_per_part=200), Chunking("maxWords", max_words=450_000, overlap=200)),
    "notebook-paid": (Limits("notebook (paid)", parts=100, words_per_part=500_000, megabytes_per_part=200), Chunking("maxWords", max_words=450_000, overlap=200)),
    "chat": (Limits("chat", parts=1, tokens_per_part=150_000, total_tokens=150_000), Chunking("maxTokens", max_tokens=150_000, overlap=0)),
    "rag": (Limits("rag", tokens_per_part=1_200), Chunking("maxTokens", max_tokens=1_000, overlap=120)),
    "per-note": (Limits("one file a note"), Chunking("perNote")),
}


@dataclass(frozen=True)
class Profile:
    id: str
    description: str = ""
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ()
    roots: tuple[str, ...] = ()
    depth: int = -1
    path_regex: str | None = None
    min_words: int = 8
    max_words: int | None = None
    max_bytes: int = 8 * 1024 * 1024
    text_files: bool = False
    tags_all: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    tags_none: tuple[str, ...] = ()
    modified_days: int | None = None
    required_key: str | None = None
    max_notes: int | None = None
    focus: str | None = None
    order: str = "path"  # path, title, modified, words, value, signal, centrality
    descending: bool = False
    transclude: bool = True
    transform: Options = field(default_factory=Options)
    dedupe: str = "collapse"  # off, skip, collapse, merge
    threshold: float = 0.9
    containment: float = 0.93
    dedupe_words: int = 40
    boilerplate: bool = True
    summary: str | None = "centroid"
    summary_ratio: float = 0.35
    summary_sentences: int | None = None
    summary_words: int = 120
    stub_words: int = 12
    redact: bool = False
    budget: int | None = None
    format: str = "markdown"  # markdown, plain, json, jsonl, xml, html
    chunking: Chunking = field(default_factory=Chunking)
    limits: Limits = field(default_factory=Limits)
    citation_ids: bool = True
    contents: bool = True
    manifest: bool = True
    report: bool = False
    instructions: bool = False
    name: str = "{{folder}} - {{date}} {{profile}}"


def _build() -> dict[str, Profile]:
    plain = Options(frontmatter="keep", comments=False, query_blocks=False, level=None, callouts=False, title_once=False, links="keep", blank_lines=2)
    made = [
        Profile("notebook", "Condensed parts under a notebook's limits per source", chunking=PRESETS["notebook-free"][1], limits=PRESETS["notebook-free"][0], report=True, instructions=True),
        Profile("chat", "One part that fits a long prompt", dedupe="skip", threshold=0.86, containment=0.95, summary_ratio=0.28, summary_words=150, chunking=PRESETS["chat"][1], limits=PRESETS["chat"][0], budget=150_000, report=True, instructions=True),
        Profile("rag", "Many small records for an index", transclude=False, transform=Options(frontmatter="keep"), dedupe="skip", threshold=0.92, containment=0.96, dedupe_words=30, summary=None, stub_words=8, format="jsonl", chunking=replace(PRESETS["rag"][1], level=3), limits=PRESETS["rag"][0], contents=False, name="{{folder}}-{{date}}-part-{{part}}"),
        Profile("mirror", "One clean file a note", dedupe="off", summary=None, chunking=PRESETS["per-note"][1], limits=PRESETS["per-note"][0], contents=False, name="{{note_path}}"),
        Profile("archive", "Everything as it is, in one file", min_words=0, transclude=False, transform=plain, dedupe="off", boilerplate=False, summary=None, stub_words=0, chunking=Chunking("single"), manifest=False, name="{{folder}}-archive-{{date}}"),
        Profile("study", "Essential sentences with outline and glossary", order="centrality", descending=True, transform=Options(tasks="dropDone", tags="hoist", code="collapse"), dedupe="merge", threshold=0.88, containment=0.95, summary="keypoints", summary_sentences=12, summary_words=200, chunking=Chunking("maxTokens", max_tokens=60_000)),
        Profile("xml", "Documents as XML for a prompt", summary="mmr", format="xml", chunking=Chunking("maxTokens", max_tokens=180_000, overlap=0)),
    ]
    return {p.id: p for p in made}


PROFILES = _build()
