"""Settings of the miner, passed as keyword arguments."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from collections.abc import Callable, Sequence

from pyspark.sql import Column


@dataclass(frozen=True)
class Mask:
    """One masking step: every match of ``pattern`` becomes prefix+name+suffix.

    ``pattern`` is written in Python ``re`` syntax. A mask may instead carry
    ``apply``, any ``Column -> Column`` function; such a mask has no pattern,
    so exact parameter extraction falls back to ``.+?`` for it.
    """

    pattern: str
    name: str
    apply: Callable[[Column], Column] | None = None


# The ordered masks of the tuned profile.
TUNED_MASKS: tuple[Mask, ...] = (
    Mask(
        r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+"
        r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+"
        r"(\d{1,2})\s+(\d{1,2}:\d{1,2}:\d{1,2})(?:\s+[A-Z]+)?\s+(\d{4})",
        "DATE",
    ),
    Mask(r"(\s+[A-Z]\d{2}\s+)", "SLOT"),
    Mask(r"(<\*>)(?:\s+<\*>)+", "*"),
    Mask(r"([\w-]+\.){2,}[\w-]+", "URL"),
    Mask(r"(://|//|\.?/)[^\s]+(?:/[^\s]*)*+/?(?<!:)(\?[^\s]*)?", "PATH"),
    Mask(r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "ID"),
    Mask(
        r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)",
        "IP",
    ),
    Mask(r"((?<=[^A-Za-z0-9])|^)(?:0x)?[a-fA-F0-9]+((?=[^A-Za-z0-9])|$)", "HEX"),
    Mask(r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "NUM"),
    Mask(r"(?<![A-Za-z0-9])((B|KB|MB|GB|sec|secs|kbps))(?![A-Za-z0-9])", "UNIT"),
    Mask(r'(?<=executed cmd )(".+?")', "CMD"),
)

# A safer order for plain text: addresses before names with dots, numbers
# before hexadecimal words, and hexadecimal only with its 0x mark.
DEFAULT_MASKS: tuple[Mask, ...] = (
    Mask(r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9])", "IP"),
    Mask(r"(?<![A-Za-z0-9])0x[a-fA-F0-9]+(?![A-Za-z0-9])", "HEX"),
    Mask(r"(?<![A-Za-z0-9])[-+]?\d+(?:\.\d+)?(?![A-Za-z0-9])", "NUM"),
)


@dataclass(frozen=True)
class MinerOptions:
    """Options shared by mining, matching and extraction.

    ``sim_th = 0.0`` asks for the threshold that grows with the line length.
    ``round_leaders`` only shapes the work (members tried as leaders per block
    at first), see ``plans.mining``. ``dictionary_veto`` and ``pos_veto`` need a
    lexicon table.
    """

    sim_th: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = None
    extra_delimiters: tuple[str, ...] = ()
    numeric_tokens: bool = True
    mask_prefix: str = "<"
    mask_suffix: str = ">"
    masks: tuple[Mask, ...] = field(default=())
    punctuation: bool = False
    reverse_blocks: bool = True
    static_veto: bool = False
    dictionary_veto: bool = False
    pos_veto: bool = False
    prefer: str = "most_wildcards"
    round_leaders: int = 64

    def __post_init__(self) -> None:
        if self.depth < 3:
            raise ValueError("depth must be at least 3")
        if self.prefer not in ("most_wildcards", "fewest_wildcards"):
            raise ValueError(f"unknown preference {self.prefer!r}")
        if self.round_leaders < 1:
            raise ValueError("round_leaders must be positive")

    @property
    def wildcard(self) -> str:
        return f"{self.mask_prefix}*{self.mask_suffix}"

    def with_(self, **changes) -> "MinerOptions":
        return replace(self, **changes)


def mask_names(masks: Sequence[Mask]) -> list[str]:
    """Distinct mask names in first-seen order."""
    return list(dict.fromkeys(m.name for m in masks))
