"""Settings of an encoding run, checked as a whole."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class Dictionary(Enum):
    OP = "OP"
    SE = "SE"
    CLASS = "CLASS"
    TREE = "TREE"
    MIXED = "MIXED"
    PMS = "PMS"


class Score(Enum):
    XOR = "XOR"
    WXOR = "WXOR"
    WAN = "WAN"
    ENT = "ENT"
    FAST = "FAST"


class Align(Enum):
    CENTER = "CENTER"
    CENTROID = "CENTROID"


STRIP_HEIGHTS = (1, 2, 4, 8)


@dataclass(frozen=True)
class Settings:
    pages: int = 1
    dictionary: Dictionary = Dictionary.MIXED
    update: bool = True
    splits: int = 1
    strip_height: int = 8
    score: Score = Score.XOR
    threshold: float = 0.15
    use_holes: bool = False
    align: Align = Align.CENTER
    lossy: bool = False
    substitute: bool = False
    residue: bool = False
    lloyd: bool = False
    small_cluster: int = 2
    large_cluster: int = 4
    #: "reference": the contour stops where it first returns to its seed; "connected": 4-connected components.
    component_mode: str = "reference"
    #: For CLASS and TREE: how many symbols to come down to.
    target_size: int | None = None

    def checked(self) -> Settings:
        """The settings as they will be used; raises ValueError if they contradict each other."""
        out = self
        if out.pages < 1 or out.splits < 1:
            raise ValueError("pages and splits must be 1 or more")
        if out.strip_height not in STRIP_HEIGHTS:
            raise ValueError(f"strip_height must be one of {STRIP_HEIGHTS}")
        if not 0 <= out.threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        if out.component_mode not in ("reference", "connected"):
            raise ValueError("component_mode must be reference or connected")
        if out.substitute:
            if out.pages > 1:
                raise ValueError("substitution works on a single page")
            out = replace(out, lossy=True, dictionary=Dictionary.PMS)
        if out.dictionary in (Dictionary.OP, Dictionary.CLASS, Dictionary.TREE) and out.pages > 1:
            raise ValueError(f"{out.dictionary.value} works on a single page")
        if out.lloyd:
            if out.pages > 1:
                raise ValueError("lloyd works on a single page")
            if out.dictionary not in (Dictionary.CLASS, Dictionary.MIXED):
                out = replace(out, lloyd=False)
        if out.residue and not out.lossy:
            out = replace(out, residue=False)
        if out.align is Align.CENTROID and out.score is not Score.XOR:
            out = replace(out, align=Align.CENTER)
        if not out.small_cluster and not out.large_cluster:
            out = replace(out, small_cluster=2, large_cluster=4)
        return out


FLAGS = {
    "-pnum": ("pages", int), "-pn": ("pages", int), "-split": ("splits", int), "-sp": ("splits", int), "-strip": ("strip_height", int), "-s": ("strip_height", int),
    "-dict": ("dictionary", lambda v: Dictionary(v.upper())), "-pm": ("score", lambda v: Score(v.upper())), "-mismatch": ("threshold", float), "-mm": ("threshold", float),
    "-align": ("align", lambda v: Align(v.upper())), "-size": ("target_size", int),
}
SWITCHES = {"-noupdate": ("update", False), "-nu": ("update", False), "-lloyd": ("lloyd", True), "-feature": ("use_holes", True), "-lossy": ("lossy", True), "-pms": ("substitute", True), "-res": ("residue", True)}


def from_flags(args: list[str]) -> tuple[Settings, list[str]]:
    """Settings from command-line flags, and the other arguments."""
    values: dict[str, object] = {}
    rest: list[str] = []
    todo = list(args)
    while todo:
        flag = todo.pop(0)
        if flag in SWITCHES:
            name, value = SWITCHES[flag]
            values[name] = value
        elif flag in FLAGS:
            if not todo:
                raise ValueError(f"{flag} needs a value")
            name, convert = FLAGS[flag]
            values[name] = convert(todo.pop(0))
        elif flag == "-cl":
            if len(todo) < 2:
                raise ValueError("-cl needs two values")
            values["small_cluster"], values["large_cluster"] = int(todo.pop(0)), int(todo.pop(0))
        elif flag.startswith("-"):
            raise ValueError(f"unknown flag {flag}")
        else:
            rest.append(flag)
    return Settings(**values).checked(), rest  # type: ignore[arg-type]
