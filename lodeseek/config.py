"""One frozen settings object, plus the environment parsing rules behind it."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

# File extension -> language label.
EXTENSION_LANG = {
    ".py": "python",
    ".ipynb": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}

# Path parts that exclude a file.
EXCLUDED_PARTS = (
    ".git", ".venv", "venv", "env", "node_modules", "site-packages",
    "__pycache__", ".mypy_cache", ".pytest_cache", ".ipynb_checkpoints",
    "dist", "build", ".next", ".turbo", ".cache", "vendor",
)

# File-name endings that exclude a file (case-sensitive).
EXCLUDED_ENDINGS = (".min.js", ".bundle.js", ".d.ts")

# Path globs that exclude a file at any depth.
EXCLUDED_GLOBS = ("explain/data.js",)

# The four answer sources, alphabetical.
SOURCE_TYPES = ("code", "textbook", "web", "youtube")

# Accepted provider hints and the default provider per task.
PROVIDER_HINTS = ("claude", "openai", "gemini")
TASK_PROVIDER = {"summary": "openai", "code": "claude"}
FALLBACK_PROVIDER = "groq"

# Query-rewrite technique labels.
TECHNIQUES = ("query_rewriting", "multi_query", "hyde", "step_back")


def env_text(key: str, default=None):
    """Environment text; blank counts as unset."""
    raw = os.environ.get(key, "")
    return raw if raw != "" else default


def env_number(key: str, default, kind=int):
    """Environment number; unset, blank or malformed gives the default."""
    raw = env_text(key)
    if raw is None:
        return default
    try:
        return kind(raw)
    except ValueError:
        return default


def env_flag(key: str, default: bool) -> bool:
    """Environment boolean; anything outside the accepted words is False."""
    raw = env_text(key)
    return default if raw is None else raw.strip().lower() in {"1", "true", "yes", "y", "on"}


# The defaults below; results depend on them.
@dataclass(frozen=True)
class Tunables:
    """Every parameter of every operator, with the documented default."""

    # code chunks, in tokens
    code_chunk_size: int = 500
    code_chunk_overlap: int = 100
    max_file_bytes: int = 400_000
    # text chunks, in characters
    text_chunk_size: int = 1200
    text_chunk_overlap: int = 150
    # embedding calls
    embed_batch: int = 128
    embed_retries: int = 6
    embed_base_delay: float = 1.0
    # keyword and vector retrieval
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_floor: float = 0.25
    bm25_k: int = 10
    vector_k: int = 5
    fetch_k: int = 10
    mmr_lambda: float = 0.5
    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    fusion_offset: int = 60
    # graph retrieval
    entity_k: int = 8
    chunk_k: int = 8
    rels_per_entity: int = 8
    community_n: int = 6
    global_chunk_k: int = 4
    community_seed: int = 42
    community_names: int = 40
    community_docs: int = 3
    community_context_chars: int = 3000
    # rerank and answer assembly
    rerank_top_n: int = 8
    max_code_examples: int = 3
    context_items: int = 8
    context_chars: int = 600
    code_block_chars: int = 1200
    textbook_tail_chunks: int = 4
    textbook_tail_chars: int = 400
    # acquisition
    web_max_results: int = 10
    web_text_chars: int = 2000
    web_retries: int = 3
    web_base_delay: float = 1.0
    video_max_results: int = 10
    video_min_views: int = 1000
    video_months: int = 6
    transcript_chars: int = 3000
    transcript_langs: tuple = ("ko", "en")
    # per-source budgets, seconds
    code_timeout: float = 12.0
    textbook_timeout: float = 12.0
    web_timeout: float = 8.0
    video_timeout: float = 15.0
    max_tool_iterations: int = 7
    # evaluation
    eval_top_k: int = 10
    eval_context_k: int = 8
    eval_communities: int = 3
    # Spark-side limits
    window_group_rows: int = 2_000_000
    query_block_rows: int = 4_096
    vector_block_rows: int = 4_096

    env_prefix: str = field(default="LODESEEK_", repr=False)

    @property
    def recursion_limit(self) -> int:
        return self.max_tool_iterations * 2 + 1

    def with_env(self) -> "Tunables":
        """Override int/float/text fields from ``<prefix><FIELD>`` variables."""
        changed = {}
        for f in fields(self):
            current = getattr(self, f.name)
            key = self.env_prefix + f.name.upper()
            if isinstance(current, bool) or f.name == "env_prefix":
                continue
            if isinstance(current, (int, float)):
                changed[f.name] = env_number(key, current, type(current))
        return replace(self, **changed)


DEFAULTS = Tunables()
