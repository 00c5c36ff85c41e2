"""Equivalence classes, representatives, and spanning forests of marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import bits

from . import matching
from .staging import cut


#: Graphs of up to so many edges (16 bytes each) are solved in the driver; larger ones in rounds of joins.
DRIVER_EDGES = 2_000_000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(mark_id, class_id): each of ``nodes`` (mark_id) with the lowest id it reaches by ``edges`` (mark_id, ref_id)."""
    edges = cut(edges.select(F.col("mark_id").alias("u"), F.col("ref_id").alias("v")).where("u <> v"))
    labels = _few_labels(edges) if _few(edges) else _many_labels(edges)
    return nodes.select("mark_id").join(labels.withColumnRenamed("u", "mark_id"), "mark_id", "left").select("mark_id", F.coalesce("label", "mark_id").alias("class_id"))


def _few(edges: DataFrame) -> bool:
    return all(t == "bigint" for n, t in edges.dtypes if n != "mm") and edges.count() <= DRIVER_EDGES


def _few_labels(edges: DataFrame) -> DataFrame:
    held = edges.toArrow()
    ids, at = np.unique(np.concatenate([held["u"].to_numpy(), held["v"].to_numpy()]), return_inverse=True)
    return edges.sparkSession.createDataFrame(pa.table({"u": ids, "label": ids[lowest(len(ids), *np.split(at, 2))]}))


def lowest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the lowest that it reaches by edges (u, v): the higher of two roots hangs from the lower, paths are halved."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _many_labels(edges: DataFrame) -> DataFrame:
    """(u, label) by rounds of least neighbouring label and label of the label, until none changes."""
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        least = cut(labels.join(near, "u").select("u", F.col("label").alias("before"), F.least("label", "near").alias("label")))
        jump = least.select(F.col("u").alias("label"), F.col("label").alias("further"))
        after = cut(least.join(jump, "label").select("u", F.least("label", "further").alias("label"), (F.col("further") != F.col("before")).alias("changed")))
        labels = after.select("u", "label")
        if not after.where("changed").limit(1).count():
            return labels


def equivalence_classes(marks: DataFrame, by: list[str], threshold: float, first_new: int | None = None) -> DataFrame:
    """Components of the graph of best matches. A copy's best match is the lowest other copy, so only the lowest are compared."""
    if first_new is not None:
        return components(marks, matching.best_with_carried(matching.matches(marks, by, threshold), by, first_new))
    alike = cut(matching.copies(marks, by))
    alone = marks.join(alike.where("mark_id <> first").select("mark_id"), "mark_id", "left_anti")
    best = matching.best_both_ways(matching.matches(alone, by, threshold), by).select("mark_id", "ref_id").join(alike.select("mark_id"), "mark_id", "left_anti")
    return components(marks, best.unionByName(alike.select("mark_id", F.col("ref").alias("ref_id"))))


def purge(classes: DataFrame, first_new: int) -> DataFrame:
    """Classes with a new member; those made up of carried ones alone go."""
    fresh = classes.groupBy("class_id").agg(F.max("mark_id").alias("last")).where(F.col("last") >= first_new).select("class_id")
    return classes.join(fresh, "class_id", "left_semi")


def medoids(marks: DataFrame, classes: DataFrame, first_new: int = 0) -> DataFrame:
    """(class_id, repre, size, mean): the member with the least mean score against the class's new members, ties to the lowest id.

    A class of one or two is represented by its lowest id. Pairs of carried members count as 0. Members with equal bitmaps
    are compared once for all, and of each only the lowest carried and the lowest new one can represent.
    """
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"), F.min("mark_id").alias("lowest"))
    held = classes.join(marks.select("mark_id", "words", "area"), "mark_id").join(sizes.where("size > 2").select("class_id"), "class_id")
    new = F.col("mark_id") >= first_new
    alike = held.groupBy("class_id", "words", "area").agg(F.count(F.when(new, 1)).alias("new"), F.min(F.when(~new, F.col("mark_id"))).alias("carried"), F.min(F.when(new, F.col("mark_id"))).alias("fresh"))
    other = alike.where("new > 0").select("class_id", F.col("words").alias("other_words"), F.col("new").alias("others"))
    pixels = bits.differing(F.col("words"), F.col("other_words"))
    means = alike.join(other, "class_id").withColumn("pixels", pixels).where("pixels IS NOT NULL")
    means = means.groupBy("class_id", "words", "area", "carried", "fresh").agg(F.sum(F.col("pixels") * F.col("others")).alias("total"), F.sum("others").alias("others"))
    own = F.array(F.struct(F.col("carried").alias("mark_id"), F.lit(0).alias("self")), F.struct(F.col("fresh").alias("mark_id"), F.lit(1).alias("self")))
    means = means.withColumn("own", F.explode(own)).select("class_id", "own.mark_id", "total", "area", (F.col("others") - F.col("own.self")).alias("others"))
    means = means.where("mark_id IS NOT NULL AND others > 0").select("class_id", "mark_id", (F.col("total") / (F.col("area") * F.col("others"))).alias("mean"))
    best = means.where("mean < 1").groupBy("class_id").agg(F.min(F.struct("mean", "mark_id")).alias("b"))
    out = sizes.join(best, "class_id", "left")
    return out.select("class_id", F.coalesce("b.mark_id", "lowest").alias("repre"), "size", F.col("b.mean").alias("mean"))


#: Marks of a group in a block; a call compares a block with the representatives in another.
BLOCK = 4096
NEAREST = pa.schema({"mark_id": pa.int64(), "pixels": pa.int64(), "to": pa.int64()})


def _words(rows: pa.Table) -> np.ndarray:
    held = rows["bitmap"].combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(held), -1)


def _nearest(asked: pa.Table, heads: pa.Table) -> pa.Table:
    """(mark_id, pixels, to) of ``asked`` and ``heads`` (id, most, bitmap), all of one area, ``most``, and number of words."""
    if not (len(asked) and len(heads)):
        return NEAREST.empty_table()
    heads = heads.sort_by("id")  # the first of equally near ones has the lowest id
    to, own, others = heads["id"].to_numpy(), _words(asked), _words(heads)
    pixels, found = np.empty(len(asked), np.int64), np.empty(len(asked), np.int64)
    for k in range(0, len(asked), 256):
        apart = sum(np.bitwise_count(own[k : k + 256, w, None] ^ others[None, :, w]).astype(np.int32) for w in range(own.shape[1]))
        best = apart.argmin(1)
        pixels[k : k + 256], found[k : k + 256] = apart[np.arange(len(best)), best], to[best]
    out = pa.table({"mark_id": asked["id"].to_numpy(), "pixels": pixels, "to": found}, NEAREST)
    return out.filter(pa.array(pixels < asked["most"].to_numpy()))


def closest(asked: DataFrame, heads: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """(mark_id, to): of each of ``asked`` (mark_id, keys, area, words, blocks) the closest of ``heads`` (to, keys, area, words, blocks), ties to the lowest ``to``.

    Marks that share no pixel with any head are left out. Each of a group's ``blocks`` meets every block of heads, in a
    call that returns a row for each mark.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own, others = ({k: f"{side}_{k}" for k in (*keys, "row", "column")} for side in ("own", "other"))

    def cells(rows: DataFrame, c: str, names: dict[str, str], within: str, across: str) -> DataFrame:
        held = [F.col(k).alias(names[k]) for k in keys]
        rows = rows.select(*held, block(c).alias(names[within]), every.alias(names[across]), F.col(c).cast("long").alias("id"), F.col("area").alias("most"), F.col("words").alias("bitmap"))
        return rows.repartition(tasks, *names.values())

    a, b = cells(asked, "mark_id", own, "row", "column"), cells(heads, "to", others, "column", "row")
    out = a.groupBy(*own.values()).cogroup(b.groupBy(*others.values())).applyInArrow(_nearest, "mark_id long, pixels long, to long")
    return out.groupBy("mark_id").agg(F.min(F.struct("pixels", "to")).alias("b")).select("mark_id", "b.to")


def lloyd(marks: DataFrame, classes: DataFrame, by: list[str], rounds: int = 100) -> DataFrame:
    """Moves members that aren't representatives, of classes over two, to the closest representative until nothing moves.

    A member that no representative is comparable with becomes a class of its own. Both classes of a move get new
    representatives.
    """
    keys = [*by, *(c for c in ("area", "n_words") if c not in by)]  # bitmaps of other areas or numbers of words have no score
    marks = cut(marks.withColumn("n_words", F.size("words")).select("mark_id", *keys, "words").dropna(subset=keys))
    sizes = cut(marks.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    blocked = cut(marks.join(sizes, keys))
    tasks = min(matching.MOST_TASKS, int(sizes.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 1))
    classes = cut(classes)
    for _ in range(rounds):
        reps = cut(medoids(marks, classes))
        movable = classes.join(reps, "class_id").where("size > 2 AND mark_id <> repre").select("mark_id", "class_id")
        heads = reps.select(F.col("repre").alias("mark_id"), F.col("class_id").alias("to")).join(blocked, "mark_id")
        near = closest(movable.select("mark_id").join(blocked, "mark_id"), heads, keys, tasks)
        moves = cut(movable.join(near, "mark_id", "left").select("mark_id", F.coalesce("to", "mark_id").alias("to"), "class_id").where("to <> class_id").select("mark_id", "to"))
        if not moves.limit(1).count():
            break
        classes = cut(classes.join(moves, "mark_id", "left").select("mark_id", F.coalesce("to", "class_id").alias("class_id")))
    return classes


def rooted_forest(nodes: list[int], edges: list[tuple[float, int, int]], first_new: int = 0) -> list[tuple[int, int | None, float | None, int, int]]:
    """A minimum spanning forest with at most one carried node (under ``first_new``) in a tree: (node, parent, mm, children, depth), parents first.

    Edges (mm, i, j) of equal weight are taken in order of i, then j. A tree's root is its carried node; else, of two nodes,
    the end i of their edge; else the first node that came into it and has two neighbours.
    """
    up = {n: n for n in nodes}
    held = {n: int(n < first_new) for n in nodes}
    trees = {n: [n] for n in nodes}
    beside: dict[int, list[tuple[int, float]]] = {n: [] for n in nodes}

    def top(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for mm, i, j in sorted(edges):
        a, b = top(i), top(j)
        if a == b or held[a] + held[b] > 1:
            continue
        if len(trees[a]) < len(trees[b]):
            a, b = b, a
        up[b] = a
        held[a] += held[b]
        trees[a] += trees.pop(b)
        beside[i].append((j, mm))
        beside[j].append((i, mm))
    out = []
    for tree in trees.values():
        carried = [n for n in tree if n < first_new]
        inner = [n for n in tree if len(beside[n]) > 1]
        root = carried[0] if carried else tree[0] if len(tree) < 3 else inner[0]
        todo: list[tuple[int, int | None, float | None, int]] = [(root, None, None, 0)]
        while todo:
            node, parent, mm, depth = todo.pop()
            below = [(n, m) for n, m in beside[node] if n != parent]
            out.append((node, parent, mm, len(below), depth))
            todo += [(n, node, m, depth + 1) for n, m in reversed(below)]
    return out


FOREST = "mark_id long, parent long, mm double, children int, depth int, position int"


def forest(marks: DataFrame, edges: DataFrame, by: list[str], first_new: int = 0) -> DataFrame:
    """The spanning forest of ``edges`` (by, i, j, mm). Marks that differ in ``by`` share no edge, so each group is solved alone."""
    nodes = marks.select(*by, F.col("mark_id").cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("mm"))
    rows = nodes.unionByName(edges.select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("mm").cast("double").alias("mm")))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        alone = group["j"].isna()
        links = group[~alone]
        found = rooted_forest(sorted(group.loc[alone, "i"].astype(int)), list(zip(links["mm"], links["i"].astype(int), links["j"].astype(int))), first_new)
        out = pd.DataFrame(found, columns=["mark_id", "parent", "mm", "children", "depth"])
        out["position"] = range(len(out))
        return out.astype({"parent": "Int64", "mm": "float64"})

    keyed = rows.groupBy(*by).applyInPandas(solve, FOREST)
    return keyed


def forest_statistics(trees: DataFrame) -> DataFrame:
    """Roots, roots alone, leaves, nodes with one, two and more children, the most children, total score."""
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    root, kids = F.col("parent").isNull(), F.col("children")
    return trees.agg(
        count(root, "roots"),
        count(root & (kids == 0), "roots_alone"),
        count(~root & (kids == 0), "leaves"),
        count(~root & (kids == 1), "one_child"),
        count(~root & (kids == 2), "two_children"),
        count(~root & (kids > 2), "more_children"),
        F.max(F.when(~root, kids)).alias("most_children"),
        F.sum("mm").alias("total_mm"),
    )


def merge_classes(sizes: dict[int, list[int]], mean, allowed, target: int) -> dict[int, list[int]]:
    """Agglomerative merging down to ``target`` classes: each time the pair whose union has the least mean at its medoid.

    ``sizes`` maps a class to its members, ``mean(members)`` returns (representative, mean), ``allowed(a, b)`` says whether two
    representatives may be merged. All pairs of a merged class are scored anew.
    """
    classes = {c: list(m) for c, m in sizes.items()}
    reps = {c: mean(m)[0] for c, m in classes.items()}

    def cost(a: int, b: int) -> float:
        return mean(classes[a] + classes[b])[1] if allowed(reps[a], reps[b]) else float("inf")

    costs = {(a, b): cost(a, b) for a in classes for b in classes if b < a}
    while len(classes) > target and costs:
        (a, b), least = min(costs.items(), key=lambda x: (x[1], x[0]))
        if least == float("inf"):
            break
        classes[b] += classes.pop(a)
        reps.pop(a)
        reps[b] = mean(classes[b])[0]
        costs = {k: v for k, v in costs.items() if a not in k and b not in k}
        costs |= {(max(b, c), min(b, c)): cost(max(b, c), min(b, c)) for c in classes if c != b}
    return classes


def superclasses(marks: DataFrame, found: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """(mark_id, class_id, parent, mm): clusters of marks by best matches outside one's own cluster, until none has any.

    Each round, every cluster's leader (the one that follows no other) takes its best match
    outside the cluster, whatever its rank (of equal ones the latest mark); where the choices run in a circle, the leader whose match is worst takes none and leads the merged cluster.
    With ``alike`` (mark_id, first, ref: ``matching.copies``, the latest first) ``found`` has the matches of the first of equal bitmaps alone: copies
    choose each other in the first round, and their cluster's leader has the matches of the first.
    """
    found = cut(matching.both_ways(found, [])).withColumns({"class_id": F.col("mark_id"), "ref_class": F.col("ref")})
    if alike is not None:
        matches, stars = found, alike.select("mark_id", "ref", F.lit(0.0).alias("mm"), F.col("mark_id").alias("class_id"), F.col("ref").alias("ref_class"))
        found = found.join(alike.select("mark_id"), "mark_id", "left_anti").unionByName(stars)
    state = cut(marks.select("mark_id", F.col("mark_id").alias("class_id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("mm")))
    best = F.min(F.struct("mm", (-F.col("ref")).alias("minus"), "ref", "ref_class")).alias("b")
    while True:  # clusters with a match at least halve
        choice = cut(found.groupBy("mark_id", "class_id").agg(best).select("mark_id", "class_id", "b.ref", "b.ref_class", "b.mm"))
        if not choice.limit(1).count():
            break
        joined, taken = _few_merged(choice) if _few(choice) else _many_merged(choice)
        state = cut(
            state.join(taken, "mark_id", "left").join(joined, "class_id", "left").select("mark_id", F.coalesce("to", "class_id").alias("class_id"), F.coalesce("parent", "new_parent").alias("parent"), F.coalesce("mm", "new_mm").alias("mm"))
        )
        # only leaders still choose, and matches inside a cluster never count again
        leaders = state.where("parent IS NULL").select("mark_id", "class_id")
        ends = state.select(F.col("mark_id").alias("ref"), F.col("class_id").alias("ref_class"))
        if alike is not None:
            firsts = leaders.join(alike, "mark_id", "left").select(F.col("mark_id").alias("own"), F.coalesce("first", "mark_id").alias("mark_id"))
            found, alike = matches.join(firsts, "mark_id").select(F.col("own").alias("mark_id"), "ref", "mm"), None
        found = cut(found.select("mark_id", "ref", "mm").join(leaders, "mark_id").join(ends, "ref").where("class_id <> ref_class"))
    return state


def _many_merged(choice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, to) of the clusters that ``choice`` joins, and (mark_id, new_parent, new_mm) of the choices taken.

    Components of the graph of clusters; each holds one circle at most, and its worst edge goes.
    """
    clusters = choice.select(F.col("class_id").alias("mark_id")).union(choice.select("ref_class")).distinct()
    joined = components(clusters, choice.select(F.col("class_id").alias("mark_id"), F.col("ref_class").alias("ref_id")))
    joined = joined.select(F.col("mark_id").alias("class_id"), F.col("class_id").alias("to"))
    worst = choice.join(_circles(choice), "class_id").join(joined, "class_id").groupBy("to").agg(F.max(F.struct("mm", "mark_id")).alias("w")).select(F.col("w.mark_id").alias("mark_id"))
    return joined, choice.join(worst, "mark_id", "left_anti").select("mark_id", F.col("ref").alias("new_parent"), F.col("mm").alias("new_mm"))


def _few_merged(choice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_many_merged``, in the driver: after as many steps along the choices as there are clusters one stands on a circle, or where no choice leads on."""
    held = {n: c.to_numpy() for n, c in zip(choice.columns, choice.toArrow().columns)}
    ids, at = np.unique(np.concatenate([held["class_id"], held["ref_class"]]), return_inverse=True)
    own, other = np.split(at, 2)
    to = lowest(len(ids), own, other)
    step = np.arange(len(ids))
    step[own] = other
    for _ in range(len(ids).bit_length()):
        step = step[step]
    round_ = np.isin(own, step)
    order = np.lexsort((held["mark_id"], held["mm"], to[own]))
    order = order[round_[order]]
    last = np.append(to[own][order][1:] != to[own][order][:-1], True) if len(order) else np.zeros(0, bool)
    taken = np.ones(len(own), bool)
    taken[order[last]] = False
    make = choice.sparkSession.createDataFrame
    return make(pa.table({"class_id": ids, "to": ids[to]})), make(pa.table({"mark_id": held["mark_id"][taken], "new_parent": held["ref"][taken], "new_mm": held["mm"][taken]}))


def _circles(choice: DataFrame) -> DataFrame:
    """Clusters whose chain of choices returns to them: those left after all that nobody chooses have been peeled off."""
    left, n = choice.select("class_id", "ref_class"), choice.count()
    while True:
        kept = cut(left.join(left.select(F.col("ref_class").alias("class_id")).distinct(), "class_id", "left_semi"))
        before, n = n, kept.count()
        if n == before:
            return kept.select("class_id")
        left = kept


def trim_tree(parents: dict[int, tuple[int | None, float]], near: dict[int, list[tuple[float, int]]], target: int) -> dict[int, tuple[int | None, float]]:
    """Moves the children of the cheapest inner node to their next best parents, which makes it a leaf, until ``target`` inner nodes are left.

    ``parents`` has (parent, score) of each node and ``near`` its possible parents by score. A node never moves below itself, nor to
    a leaf: else that would become an inner node, and the number of them would not fall.
    """
    tree = dict(parents)

    def below(n: int) -> set[int]:
        out, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for c, (p, _) in tree.items():
                if p == x and c not in out:
                    out.add(c)
                    todo.append(c)
        return out

    def cost(n: int) -> tuple[float, dict[int, tuple[int, float]]] | None:
        moves, total, before = {}, 0.0, dict(tree)
        above = {p for p, _ in before.values()} - {n}
        for c in sorted(x for x, (p, _) in tree.items() if p == n):
            barred = below(c) | {n}
            option = next(((m, r) for m, r in near.get(c, []) if r in above and r not in barred), None)
            if option is None:
                tree.clear()
                tree.update(before)
                return None
            moves[c] = (option[1], option[0])
            total += option[0] - tree[c][1]
            tree[c] = moves[c]
        tree.clear()
        tree.update(before)
        return total, moves

    while True:
        inner = sorted({p for p, _ in tree.values() if p is not None and tree.get(p, (None, 0))[0] is not None})
        if len(inner) <= target:
            return tree
        options = [(c[0], n, c[1]) for n in inner if (c := cost(n))]
        if not options:
            return tree
        for child, place in min(options, key=lambda o: (o[0], o[1]))[2].items():
            tree[child] = place
