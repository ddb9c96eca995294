"""Meta clusters: patterns alike in their words, by single linkage and refinement.

Groups of equal word signatures are linked where the normalised edit distance of the signatures is
below a ratio; lengths alone rule most pairs out before a distance is computed. Components come from distributed
label propagation; a cluster whose patterns lie too far apart is split by a stricter ratio.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import common_places, edit_distance, levenshtein_ids
from .settling import settled

_PART = r"(<[a-z0-9]+>|\w+|.)"


def _parts(ptn):
    return F.regexp_extract_all(ptn, F.lit(_PART), F.lit(1))


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node that edges reach, by propagation with jumps over labels."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settled(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(now, both["a"] == now["node"]).groupBy("b").agg(F.min("label").alias("near"))
        next_ = now.join(near, now["node"] == near["b"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"))
        up = next_.select(F.col("node").alias("label"), F.col("label").alias("up"))
        next_ = settled(next_.join(up, "label").select("node", F.col("up").alias("label")))
        if next_.join(now.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            return next_
        now = next_


def _split(cluster: pd.DataFrame, diff_ratio: float, speed: float, looseness: float) -> pd.DataFrame:
    """One cluster, split until each part is tight; then its name by what all members share."""
    members = [(p, list(s), list(w)) for p, s, w in sorted(zip(cluster["ptn"], cluster["parts"], cluster["words"], strict=True))]
    far = functools.cache(lambda kind, i, j: edit_distance(kind_of[kind][i], kind_of[kind][j]) / max(1, len(kind_of[kind][i]), len(kind_of[kind][j])))
    codes = {t: i for i, t in enumerate(sorted({t for _, s, _ in members for t in s}))}
    full = [[codes[t] for t in s] for _, s, _ in members]
    word = [[codes[t] for t in w] for _, _, w in members]
    kind_of = {"full": full, "word": word}
    todo, done = [(list(range(len(members))), diff_ratio)], []
    while todo:
        group, ratio = todo.pop()
        pairs = [(i, j) for a, i in enumerate(group) for j in group[a + 1 :]]
        if not pairs or ratio < 1e-3 or sum(far("full", i, j) for i, j in pairs) / len(pairs) <= looseness:
            done.append(group)
            continue
        ratio /= speed
        root = {i: i for i in group}

        def find(i: int, root=root) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            if far("word", i, j) < ratio:
                root[max(find(i), find(j))] = min(find(i), find(j))
        todo += [([i for i in group if find(i) == r], ratio) for r in sorted({find(i) for i in group})]
    rows = []
    for group in done:
        name, kept = members[group[0]][1], list(range(len(full[group[0]])))
        for i in group[1:]:
            kept = [kept[p] for p in common_places([full[group[0]][k] for k in kept], full[i])]
        shown = "".join(t if k in set(kept) else "*" for k, t in enumerate(name))
        rows += [(members[i][0], members[group[0]][0], shown) for i in group]
    return pd.DataFrame(rows, columns=["ptn", "meta", "meta_ptn"])


def meta_clusters(ptns: DataFrame, diff_ratio: float = 0.30, refinement_speed: float = 2.0, looseness: float = 0.20) -> DataFrame:
    """``ptn, meta, meta_ptn``: each pattern's cluster, named by its least pattern, and the cluster's common text.

    Patterns with equal word sequences are together at first. A cluster's refinement is one task: its members are
    patterns, of which a site has thousands, not messages. An empty input gives no rows.
    """
    parts = _parts(F.col("ptn"))
    rows = settled(ptns.select("ptn", parts.alias("parts"), F.filter(parts, lambda t: t.rlike(r"^\w+$")).alias("words")).distinct())
    groups = settled(rows.groupBy("words").agg(F.min("ptn").alias("node")).withColumn("n", F.size("words")))
    # the same token for the i-th time is an element of its own; of sequences nearer than the ratio, the
    # least few elements have one in common
    element = F.transform("words", lambda w, i: F.xxhash64(w, F.size(F.filter(F.slice("words", F.lit(1), i), lambda x: x == w))))
    coded = settled(groups.where("n > 0").select("node", "n", F.transform("words", lambda w: F.xxhash64(w)).alias("ids"), F.sort_array(element).alias("elements")))
    few = F.slice("elements", F.lit(1), F.floor(F.col("n") * min(diff_ratio, 1.0)).cast("int") + 1)
    keyed = coded.select("node", "n", F.explode(few).alias("element"))
    left, right = (keyed.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), "element") for x in ("a", "b"))
    longest = F.greatest("n_a", "n_b")
    near = left.join(right, "element").where((F.col("a") < F.col("b")) & (F.abs(F.col("n_a") - F.col("n_b")) / longest < diff_ratio)).select("a", "b", "n_a", "n_b").distinct()
    near = near.join(coded.select(F.col("node").alias("a"), F.col("ids").alias("x")), "a").join(coded.select(F.col("node").alias("b"), F.col("ids").alias("y")), "b")
    edges = near.where(levenshtein_ids("x", "y") / longest < diff_ratio).select("a", "b")
    labels = _labels(groups, edges)
    member = rows.join(groups.select("words", "node"), "words").join(labels, "node").select("ptn", "parts", "words", "label")
    return member.groupBy("label").applyInPandas(lambda c: _split(c, diff_ratio, refinement_speed, looseness), "ptn string, meta string, meta_ptn string")
