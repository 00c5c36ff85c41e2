"""From page images to one file of segments for each document, and a report of what the bits went to.

Pages of a document are a fold, as the dictionary is carried from stripe to stripe; documents are independent
groups. ``encode`` runs the fold of each document in a task of its own. The set-wise operators of this package
give the same dictionaries and placements as tables where the order of a fold isn't needed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.config import Align, Dictionary, Settings
from glyphlake.functions import models, scores
from glyphlake.functions.mq import Encoder
from glyphlake.operators import clusters, extract
from glyphlake.operators.extract import Mark
from glyphlake.sources import container, pbm
from glyphlake.sources.container import Kind, Segment


@dataclass
class Entry:
    """A symbol of the dictionary; ``ref`` is the place of the one it refines."""

    bitmap: np.ndarray
    holes: int
    ref: int | None = None
    singleton: bool = False
    carried: bool = False
    marks: tuple[int, ...] = ()


@dataclass
class Report:
    doc_id: str = ""
    page_no: int = 0
    split_no: int = 0
    marks: int = 0
    specks: int = 0
    direct_symbols: int = 0
    refined_symbols: int = 0
    carried_symbols: int = 0
    placed_plain: int = 0
    placed_refined: int = 0
    cleanup_marks: int = 0
    size_bits: int = 0
    location_bits: int = 0
    index_bits: int = 0
    offset_bits: int = 0
    misc_bits: int = 0
    direct_bits: int = 0
    refine_bits: int = 0
    cleanup_bits: int = 0
    residue_bits: int = 0
    uncoded_direct_bits: int = 0
    uncoded_refine_bits: int = 0
    uncoded_cleanup_bits: int = 0
    segment_bytes: int = 0


REPORT = ", ".join(f"{f.name} {'string' if f.name == 'doc_id' else 'long'}" for f in fields(Report))
TOTALS = [f.name for f in fields(Report)][3:]


class Meter:
    """An encoder that books its bits under what they were spent on."""

    def __init__(self, report: Report):
        self.coder, self.report = Encoder(), report

    def spend(self, on: str, code: Callable, *args, **more) -> None:
        before = self.coder.coded_bits()
        code(self.coder, *args, **more)
        setattr(self.report, on, getattr(self.report, on) + self.coder.coded_bits() - before)


def matcher(settings: Settings) -> tuple[Callable[[Entry | Mark, Entry | Mark], bool], Callable[[np.ndarray, np.ndarray], float]]:
    """Whether two symbols are compared at all, and their score."""
    kernel = scores.REGISTRY[settings.score.value]
    if settings.score.value == "FAST":
        kernel = lambda a, b: scores.clustered(a, b, settings.small_cluster, settings.large_cluster)
    alike = lambda a, b: a.bitmap.shape == b.bitmap.shape and (not settings.use_holes or a.holes == b.holes)
    return alike, kernel


def nearest(mark, entries: list[Entry], settings: Settings) -> tuple[int | None, float]:
    """The first best entry up to the threshold."""
    alike, score = matcher(settings)
    best: tuple[float, int | None] = (1.0, None)
    for k, e in enumerate(entries):
        if alike(mark, e):
            mm = float(np.float32(score(mark.bitmap, e.bitmap)))
            if mm < best[0]:
                best = (mm, k)
                if mm == 0:
                    break
    return (best[1], best[0]) if best[1] is not None and best[0] <= np.float32(settings.threshold) else (None, best[0])


def classes_of(symbols: list, first_new: int, settings: Settings) -> list[list[int]]:
    """Components of the graph of best matches; those of carried symbols alone are left out."""
    alike, score = matcher(settings)
    best: dict[int, tuple[float, int]] = {}
    new_old: dict[int, tuple[float, int]] = {}
    limit = np.float32(settings.threshold)
    buckets = defaultdict(list)
    for i, s in enumerate(symbols):
        buckets[(s.bitmap.shape, s.holes if settings.use_holes else 0)].append(i)

    def offer(a: int, mm: float, b: int) -> None:
        best[a] = min(best.get(a, (2.0, -1)), (mm, b))

    for group in buckets.values():
        for x, i in enumerate(group):
            for j in group[:x]:
                mm = float(np.float32(score(symbols[i].bitmap, symbols[j].bitmap)))
                if mm <= limit:
                    offer(i, mm, j)
                    if i >= first_new > j:  # the old one takes it only if it is the new one's best
                        new_old[i] = min(new_old.get(i, (2.0, -1)), (mm, j))
                    else:
                        offer(j, mm, i)
    for i, (mm, j) in new_old.items():
        offer(j, mm, i)
    up = list(range(len(symbols)))

    def top(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, (_, b) in best.items():
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for n in range(len(symbols)):
        groups[top(n)].append(n)
    return [g for g in groups.values() if g[-1] >= first_new]


def medoid(members: list[int], symbols: list, first_new: int, settings: Settings) -> tuple[int, float]:
    _, score = matcher(settings)
    if len(members) < 3:
        return members[0], score(symbols[members[0]].bitmap, symbols[members[-1]].bitmap) if len(members) == 2 else 0.0
    best = (1.0, members[0])
    for i in members:
        others = [score(symbols[i].bitmap, symbols[j].bitmap) if max(i, j) >= first_new else 0.0 for j in members if j != i and j >= first_new]
        if others:
            best = min(best, (sum(others) / len(others), i))
    return best[1], best[0]


def grown_from_trees(carried: list[Entry], marks: list[Mark], settings: Settings) -> list[Entry]:
    """Classes, their representatives, a spanning forest over those of two members or more, parents before children."""
    symbols = [*carried, *marks]
    first = len(carried)
    groups = classes_of(symbols, first, settings)
    if settings.dictionary is Dictionary.CLASS and settings.target_size:
        alike, _ = matcher(settings)
        merged = clusters.merge_classes(
            {g[0]: g for g in groups}, lambda m: medoid(sorted(m), symbols, first, settings), lambda a, b: alike(symbols[a], symbols[b]), settings.target_size
        )
        groups = [sorted(g) for g in merged.values()]
    reps = sorted({medoid(g, symbols, first, settings)[0] for g in groups if len(g) > 1} | set(range(first)))
    alike, score = matcher(settings)
    limit = np.float32(settings.threshold)
    edges, near = [], defaultdict(list)
    for x, i in enumerate(reps):
        for j in reps[:x]:
            if (i >= first or j >= first) and alike(symbols[i], symbols[j]):
                mm = float(np.float32(score(symbols[i].bitmap, symbols[j].bitmap)))
                if mm < limit:
                    edges.append((mm, i, j))
                    near[i].append((mm, j))
                    near[j].append((mm, i))
    forest = clusters.rooted_forest(reps, edges, first)
    parents = {n: (p, m or 0.0) for n, p, m, _, _ in forest}
    order = [n for n, *_ in forest]
    if settings.dictionary is Dictionary.TREE and settings.target_size:
        parents = clusters.trim_tree(parents, {n: sorted(v) for n, v in near.items()}, settings.target_size)
        order = sorted(order, key=lambda n: depth_of(n, parents))
    entries = list(carried)
    at = {n: n for n in range(first)}
    for n in order:
        if n >= first:
            parent = parents[n][0]
            at[n] = len(entries)
            entries.append(Entry(symbols[n].bitmap, symbols[n].holes, at.get(parent) if parent is not None else None, marks=(n - first,)))
    return entries


def depth_of(n: int, parents: dict) -> int:
    depth = 0
    while parents[n][0] is not None:
        n, depth = parents[n][0], depth + 1
    return depth


def grown_in_order(carried: list[Entry], marks: list[Mark], settings: Settings) -> list[Entry]:
    """Every mark enters with its best earlier symbol; with substitution only marks that match none."""
    entries = list(carried)
    for e in entries:
        e.singleton = False
    for k, m in enumerate(marks):
        ref, _ = nearest(m, entries, settings)
        if settings.dictionary is Dictionary.PMS and ref is not None:
            continue
        if ref is not None:
            entries[ref].singleton = False
        alone = settings.dictionary is Dictionary.SE
        entries.append(Entry(m.bitmap, m.holes, ref, alone, marks=(k,)))
    return entries


def tidied(entries: list[Entry], settings: Settings) -> list[Entry]:
    """Shapes unified if lossy; entries equal to their reference and singletons leave, and references follow."""
    entries = [Entry(e.bitmap, e.holes, e.ref, e.singleton, e.carried, e.marks) for e in entries]
    if settings.lossy and not settings.substitute:
        for e in entries:
            if e.ref is not None and not e.carried and e.bitmap.shape == entries[e.ref].bitmap.shape:
                e.bitmap, _ = extract.unify_shape(e.bitmap, entries[e.ref].bitmap)
    to: dict[int, int] = {}
    for k, e in enumerate(entries):
        if e.ref is not None and e.ref in to:
            e.ref = to[e.ref]
        if e.ref is not None and not e.carried and np.array_equal(e.bitmap, entries[e.ref].bitmap):
            to[k] = e.ref
    kept = [k for k, e in enumerate(entries) if k not in to and (e.carried or not e.singleton)]
    place = {k: n for n, k in enumerate(kept)}
    out = []
    for k in kept:
        e = entries[k]
        e.ref = place.get(e.ref) if e.ref is not None else None
        out.append(e)
    return out


def ordered(entries: list[Entry]) -> tuple[list[Entry], list[Entry], list[Entry]]:
    """Carried entries; direct ones by height, width and arrival; refined ones likewise, but never before what they refine."""
    carried = [e for e in entries if e.carried]
    size = lambda k: (*entries[k].bitmap.shape, k)
    new = [k for k, e in enumerate(entries) if not e.carried]
    direct = sorted((k for k in new if entries[k].ref is None), key=size)
    waiting = sorted((k for k in new if entries[k].ref is not None), key=size)
    done, refined = {k for k, e in enumerate(entries) if e.carried} | set(direct), []
    while waiting:
        ready = [k for k in waiting if entries[k].ref in done]
        refined += ready
        done |= set(ready)
        waiting = [k for k in waiting if k not in done]
    place = {k: n for n, k in enumerate([*(k for k, e in enumerate(entries) if e.carried), *direct, *refined])}
    for k in refined:
        entries[k].ref = place[entries[k].ref]
    return carried, [entries[k] for k in direct], [entries[k] for k in refined]


def bits_for(n: int) -> int:
    return max(0, (n - 1).bit_length())


def heights(entries: list[Entry]) -> list[list[Entry]]:
    """Runs of equal height."""
    out: list[list[Entry]] = []
    for e in entries:
        if out and out[-1][0].bitmap.shape[0] == e.bitmap.shape[0]:
            out[-1].append(e)
        else:
            out.append([e])
    return out


def export_runs(flags: list[bool]) -> list[int]:
    """Lengths of runs, the first of them of False."""
    out, value = [0], False
    for f in flags:
        if f == value:
            out[-1] += 1
        else:
            out.append(1)
            value = f
    return out


def symbols_segment(new: list[Entry], known: list[Entry], flags: list[bool], report: Report, refines: bool) -> bytes:
    meter = Meter(report)
    before = 0
    every = [*known, *new]
    for group in heights(new):
        height, width = group[0].bitmap.shape[0], 0
        meter.spend("size_bits", models.integer, "dh", height - before)
        for e in group:
            meter.spend("size_bits", models.integer, "dw", e.bitmap.shape[1] - width)
            width = e.bitmap.shape[1]
            if refines:
                meter.spend("misc_bits", models.integer, "ai", 1)
                meter.spend("index_bits", models.symbol_id, bits_for(len(every)), e.ref)
                ref = every[e.ref].bitmap
                dx, dy = offsets(e.bitmap, ref)
                meter.spend("offset_bits", models.integer, "rdx", dx)
                meter.spend("offset_bits", models.integer, "rdy", dy)
                meter.spend("refine_bits", models.refined, ref, *e.bitmap.shape, dx, dy, e.bitmap)
                report.uncoded_refine_bits += e.bitmap.size
            else:
                meter.spend("direct_bits", models.direct, *e.bitmap.shape, e.bitmap)
                report.uncoded_direct_bits += e.bitmap.size
        meter.spend("size_bits", models.integer, "dw", None)
        before = height
    for run in export_runs(flags):
        meter.spend("misc_bits", models.integer, "ex", run)
    return container.symbols_head(refines, sum(flags), len(new)) + meter.coder.finish()


def offsets(bitmap: np.ndarray, ref: np.ndarray) -> tuple[int, int]:
    """Where the reference lies when the middles fall together."""
    return (bitmap.shape[1] - 1) // 2 - (ref.shape[1] - 1) // 2, bitmap.shape[0] // 2 - ref.shape[0] // 2


@dataclass
class Placed:
    mark: Mark
    index: int
    refined: bool


def placements(marks: list[Mark], entries: list[Entry], settings: Settings) -> tuple[list[Placed], list[Mark]]:
    """Marks that the dictionary can stand for, and those left to the cleanup page."""
    out, rest = [], []
    for m in marks:
        ref, mm = nearest(m, entries, settings)
        if ref is None:
            rest.append(m)
            continue
        e = entries[ref]
        if settings.substitute:
            dx, dy = offsets(m.bitmap, e.bitmap)
            out.append(Placed(Mark(m.x + dx, m.y + dy, e.bitmap, e.holes), ref, False))
        elif settings.lossy and m.bitmap.shape == e.bitmap.shape:
            shape, same = extract.unify_shape(m.bitmap, e.bitmap)
            out.append(Placed(Mark(m.x, m.y, shape, m.holes), ref, not same))
        else:
            out.append(Placed(m, ref, mm != 0 or not np.array_equal(m.bitmap, e.bitmap)))
    return out, rest


def strips_of(placed: list[Placed], height: int) -> list[tuple[int, list[Placed]]]:
    groups = defaultdict(list)
    for p in placed:
        groups[p.mark.bottom // height * height].append(p)
    return [(top, sorted(g, key=lambda p: p.mark.x)) for top, g in sorted(groups.items())]


def common_gap(strips: list[tuple[int, list[Placed]]]) -> int:
    counts: dict[int, int] = defaultdict(int)
    for _, row in strips:
        for a, b in zip(row, row[1:]):
            gap = b.mark.x - (a.mark.x + a.mark.width - 1)
            if gap >= 0:
                counts[gap] += 1
    return max(-16, min(15, min((g for g in counts if counts[g] == max(counts.values())), default=0)))


def text_segment(placed: list[Placed], entries: list[Entry], size: tuple[int, int], top: int, settings: Settings, report: Report) -> bytes:
    meter = Meter(report)
    strips = strips_of(placed, settings.strip_height)
    gap, refines = common_gap(strips), any(p.refined for p in placed)
    shift = settings.strip_height.bit_length() - 1
    meter.spend("location_bits", models.integer, "dt", 0)
    last_top = last_x = 0
    for strip_top, row in strips:
        meter.spend("location_bits", models.integer, "dt", (strip_top - last_top) >> shift)
        for k, p in enumerate(row):
            if not k:
                meter.spend("location_bits", models.integer, "fs", p.mark.x - last_x)
                last_x = p.mark.x
            else:
                before = row[k - 1].mark
                meter.spend("location_bits", models.integer, "ds", p.mark.x - (before.x + before.width - 1) - gap)
            if shift:
                meter.spend("location_bits", models.integer, "it", p.mark.bottom - strip_top)
            meter.spend("index_bits", models.symbol_id, bits_for(len(entries)), p.index)
            if refines:
                meter.spend("misc_bits", models.integer, "ri", int(p.refined))
                if p.refined:
                    ref, own = entries[p.index].bitmap, p.mark.bitmap
                    meter.spend("size_bits", models.integer, "rdw", own.shape[1] - ref.shape[1])
                    meter.spend("size_bits", models.integer, "rdh", own.shape[0] - ref.shape[0])
                    dx, dy = offsets(own, ref)
                    meter.spend("offset_bits", models.integer, "rdx", dx)
                    meter.spend("offset_bits", models.integer, "rdy", dy)
                    meter.spend("refine_bits", models.refined, ref, *own.shape, dx, dy, own)
                    report.uncoded_refine_bits += own.size
        meter.spend("location_bits", models.integer, "ds", None)
        last_top = strip_top
    return container.text_head(size[1], size[0], top, refines, shift, gap, len(placed)) + meter.coder.finish()


def painted(size: tuple[int, int], marks: list[Mark]) -> np.ndarray:
    canvas = np.zeros(size, np.uint8)
    for m in marks:
        extract.paint(canvas, m.bitmap, m.x, m.y)
    return canvas


def encode_document(doc_id: str, pages: list[tuple[int, np.ndarray]], settings: Settings) -> tuple[bytes, list[Segment], list[Report]]:
    """The file of one document, its segments and a report for each stripe."""
    settings = settings.checked()
    segments: list[Segment] = []
    reports: list[Report] = []
    carried: list[Entry] = []
    dictionaries: tuple[int, ...] = ()

    def add(segment: Segment) -> int:
        segments.append(segment)
        return len(segments) - 1

    for number, (page_no, page) in enumerate(pages, 1):
        add(Segment(Kind.PAGE, number, container.page_info(page.shape[1], page.shape[0], not (settings.lossy and settings.substitute), settings.splits)))
        parts = pbm.stripes_of(page, settings.splits, settings.component_mode)
        for split, (top, height) in enumerate(parts):
            report = Report(doc_id, page_no, split)
            original = page[top : top + height]
            stripe = extract.smooth_edges(original) if settings.lossy and not settings.substitute else original
            found = extract.extract_marks(stripe, settings.component_mode)
            specks = [m for m in found if m.speck]
            marks = extract.attach_dots([m for m in found if not m.speck])
            report.marks, report.specks = len(marks), 0 if settings.lossy else len(specks)
            if settings.update or not segments or not dictionaries:
                grow = grown_from_trees if settings.dictionary in (Dictionary.MIXED, Dictionary.CLASS, Dictionary.TREE) else grown_in_order
                held, direct, refined = ordered(tidied(grow(carried, marks, settings), settings))
                known = [*held, *direct]
                new_direct = add(Segment(Kind.SYMBOLS, 0, symbols_segment(direct, [], [True] * len(direct), report, False), retain=True))
                entries = [*known, *refined]
                used = {nearest(m, entries, settings)[0] for m in marks}
                for e in refined:
                    used.add(e.ref)
                flags = [not e.carried or k in used for k, e in enumerate(entries)]
                refers = (*dictionaries, new_direct)
                last = add(Segment(Kind.SYMBOLS, 0, symbols_segment(refined, known, flags, report, True), refers, True, (False,) * len(refers)))
                report.direct_symbols, report.refined_symbols, report.carried_symbols = len(direct), len(refined), len(held)
                entries = [e for e, f in zip(entries, flags) if f]  # what the page doesn't use is evicted
                dictionaries = (last,)
            else:
                entries = carried
            placed, rest = placements(marks, entries, settings)
            report.placed_refined = sum(p.refined for p in placed)
            report.placed_plain, report.cleanup_marks = len(placed) - report.placed_refined, len(rest)
            more = number < len(pages) or split + 1 < len(parts)
            add(Segment(Kind.TEXT, number, text_segment(placed, entries, original.shape, top, settings, report), dictionaries, retain_refs=(more,)))
            cleanup = painted(original.shape, rest + ([] if settings.lossy else specks))
            meter = Meter(report)
            meter.spend("cleanup_bits", models.direct, *cleanup.shape, cleanup)
            report.uncoded_cleanup_bits = cleanup.size
            add(Segment(Kind.GENERIC, number, container.generic_head(cleanup.shape[1], cleanup.shape[0], top) + meter.coder.finish()))
            if settings.residue:
                shown = cleanup | painted(original.shape, [p.mark for p in placed])
                meter = Meter(report)
                meter.spend("residue_bits", models.refined, shown, *original.shape, 0, 0, original)
                add(Segment(Kind.REFINEMENT, number, container.refinement_head(original.shape[1], original.shape[0], top) + meter.coder.finish()))
            if settings.splits > 1:
                add(Segment(Kind.END_OF_STRIPE, number, container.big(top + height - 1, 4)))
            carried = [Entry(e.bitmap, e.holes, None, False, True) for e in entries]
            report.segment_bytes = sum(len(s.data) for s in segments) - sum(r.segment_bytes for r in reports)
            reports.append(report)
        add(Segment(Kind.END_OF_PAGE, number))
    add(Segment(Kind.END_OF_FILE, 0))
    body = b"".join(s.header(n) + s.data for n, s in enumerate(segments))
    return container.file_header(len(pages)) + body, segments, reports


ENCODED = "doc_id string, content binary, pages int"


def _documents(pages: DataFrame, settings: Settings, schema: str, rows: Callable) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("page_no")
        images = [(int(p.page_no), pbm.pixels(p.raster, p.width, p.height)) for p in group.itertuples(index=False)]
        doc = group["doc_id"].iloc[0]
        return pd.DataFrame(rows(doc, images, *encode_document(doc, images, settings)), columns=[c.split()[0] for c in schema.split(", ")])

    return pages.groupBy("doc_id").applyInPandas(run, schema)


def encode(pages: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, content, pages): the file of each document of ``pages``."""
    return _documents(pages, settings, ENCODED, lambda doc, images, content, segments, reports: [(doc, content, len(images))])


def reports(pages: DataFrame, settings: Settings) -> DataFrame:
    """A row of counters for each stripe."""
    return _documents(pages, settings, REPORT, lambda doc, images, content, segments, reports: [tuple(vars(r).values()) for r in reports])


def totals(report: DataFrame) -> DataFrame:
    """Counters by document, page and stripe with totals over each, and ratios of uncoded to coded bits."""
    out = report.rollup("doc_id", "page_no", "split_no").agg(*(F.sum(c).alias(c) for c in TOTALS))
    ratio = lambda c: F.when(F.col(f"{c}_bits") > 0, F.col(f"uncoded_{c}_bits") / F.col(f"{c}_bits")).alias(f"{c}_ratio")
    return out.select("*", ratio("direct"), ratio("refine"), ratio("cleanup"))


def segments(pages: DataFrame, settings: Settings) -> DataFrame:
    """The segments of each document's file."""
    schema = "doc_id string, seg_no int, type int, page int, refers array<int>, retain boolean, data binary"
    return _documents(pages, settings, schema, lambda doc, images, content, segs, reports: [(doc, n, int(s.kind), s.page, list(s.refers), s.retain, s.data) for n, s in enumerate(segs)])
