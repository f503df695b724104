"""What a retrieval asks for: modes, filters, blends, presets, confidence floors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from enum import IntEnum

#: Fixed values of the retrieval semantics.
RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75
COARSE_K, COARSE_LEAST, COARSE_MARGIN = 6, 3, 0.05
GRAPH_SEEDS, DEFAULT_TOP, RERANK_WINDOW, RANK_TEXT_CHARS = 5, 5, 50, 2000
RECENCY_SHARE, RECENCY_BASE = 0.15, 0.5


class Detail(IntEnum):
    OVERVIEW = 1
    ENTRY = 2
    RAW = 3


@dataclass(frozen=True)
class Floors:
    """Below floor a cosine top score, below rerank a reranked one, is a miss; below margin two are tied."""

    floor: float
    margin: float
    rerank: float = 0.5
    calibrated: bool = False

    @staticmethod
    def of_model(model: str, floor: float | None = None, margin: float | None = None, rerank: float | None = None) -> Floors:
        base = {"BAAI/bge-small-en-v1.5": (0.68, 0.05), "mock-bow": (0.0, 0.0)}.get(model, (0.5, 0.03))
        return Floors(base[0] if floor is None else floor, base[1] if margin is None else margin, 0.5 if rerank is None else rerank, floor is not None)


def _number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def resolve_floors(model: str, config: Callable[[str], str | None]) -> Floors:
    """The model's floors, overridden by what config holds under conf.floor, conf.margin and conf.rerank."""
    return Floors.of_model(model, *(_number(config(f"conf.{name}.{model}")) for name in ("floor", "margin", "rerank")))


@dataclass(frozen=True)
class QuerySpec:
    """candidates: flat, collapsed or hierarchical; mode: vector or hybrid."""

    candidates: str = "flat"
    mode: str = "vector"
    top_k: int = DEFAULT_TOP
    kinds: tuple[str, ...] = ()
    tier: str | None = None
    include_superseded: bool = False
    coarse_k: int = COARSE_K
    min_score: float = 0.0
    recency_half_life_days: float = 0.0
    importance_weight: float = 0.0
    graph_boost: float = 0.0
    rerank: bool = False
    auto_rerank: bool = False
    rerank_n: int = RERANK_WINDOW
    detail: Detail = Detail.OVERVIEW
    now: datetime | None = None
    floors: Floors = field(default_factory=lambda: Floors.of_model(""))

    def but(self, **changes) -> QuerySpec:
        return replace(self, **changes)


#: Modes by name; any other name is flat vector search.
PRESETS = {
    "collapsed": QuerySpec("collapsed"),
    "hybrid": QuerySpec("flat", "hybrid"),
    "hierarchical": QuerySpec("hierarchical", "hybrid"),
    "hierarchical-vector": QuerySpec("hierarchical"),
    "collapsed-hybrid": QuerySpec("collapsed", "hybrid"),
}


def preset(name: str) -> QuerySpec:
    return PRESETS.get(name, QuerySpec())


def parse_kinds(text: str) -> tuple[str, ...]:
    """Comma-separated kinds; 'file' is a document; unknown names are left out."""
    known = {"answer", "insight", "summary", "document", "reasoning", "seed"}
    names = ("document" if x == "file" else x for x in (part.strip().lower() for part in text.split(",")))
    return tuple(x for x in names if x in known)


def parse_role(text: str) -> str:
    return text if text in ("worktree", "workspace", "session") else "session"


def parse_tier(text: str) -> str | None:
    return text if text in ("worktree", "workspace") else None


def parse_detail(text: str) -> Detail:
    return {"entry": Detail.ENTRY, "raw": Detail.RAW}.get(text, Detail.OVERVIEW)
