"""Parameters of a build."""

from __future__ import annotations

from dataclasses import dataclass

from twigmer.functions.scoring import ALPHABETS, LONGEST, log_threshold, score_threshold

GHOSTS = ("both", "inner-only", "outer-only")
ENGINES = ("numpy", "hof", "join", "sorted", "chained")
FILTERS = ("mif0", "random")
# Models that the reconstruction tools know.
NUCL_MODELS = (
    "JC", "K80", "F81", "F84", "HKY", "TN93ef", "TN93", "K81", "K81uf", "TPM2", "TPM2uf", "TPM3", "TPM3uf", "TIM1", "TIM1uf", "TIM2", "TIM2uf",
    "TIM3", "TIM3uf", "TVMef", "TVM", "SYM", "GTR",
)
AMINO_MODELS = (
    "Blosum62", "cpREV", "Dayhoff", "DCMut", "DEN", "FLU", "HIVb", "HIVw", "JTT", "JTT-DCMut", "LG", "mtART", "mtMAM", "mtREV", "mtZOA", "PMB",
    "rtREV", "stmtREV", "VT", "WAG", "LG4M", "LG4X", "PROTGTR",
)


@dataclass(frozen=True)
class BuildParams:
    """What a database is built with; wrong values raise ``ValueError``."""

    states: str = "nucl"
    k: int = 8
    omega: float = 1.5
    reduction_ratio: float = 0.99
    no_reduction: bool = False
    ghosts: str = "both"
    use_unrooted: bool = False
    merge_branches: bool = False
    keep_positions: bool = False
    filter: str = "mif0"
    mu: float = 1.0
    engine: str = "numpy"
    model: str | None = None
    alpha: float = 1.0
    categories: int = 4
    convert_uo: bool = False
    uncompressed: bool = False

    def __post_init__(self) -> None:
        if self.states not in ALPHABETS:
            raise ValueError(f"states must be one of {', '.join(ALPHABETS)}")
        if not 1 <= self.k <= LONGEST[self.states]:
            raise ValueError(f"k must be from 1 to {LONGEST[self.states]} for {self.states}")
        if not 0 < self.omega < len(self.alphabet):
            raise ValueError("omega must be above 0 and under the size of the alphabet")
        if not 0 < self.reduction_ratio <= 1 or not 0 < self.mu <= 1:
            raise ValueError("ratios must be above 0 and at most 1")
        for value, known in ((self.ghosts, GHOSTS), (self.filter, FILTERS), (self.engine, ENGINES)):
            if value not in known:
                raise ValueError(f"{value!r} isn't one of {', '.join(known)}")
        if self.model is not None and self.model not in (NUCL_MODELS if self.states == "nucl" else AMINO_MODELS):
            raise ValueError(f"unknown model {self.model}")

    @property
    def alphabet(self) -> str:
        return ALPHABETS[self.states]

    @property
    def sigma(self) -> int:
        return len(self.alphabet)

    @property
    def log_threshold(self) -> float:
        return log_threshold(self.omega, self.k, self.sigma)

    @property
    def threshold(self) -> float:
        return score_threshold(self.omega, self.k, self.sigma)
