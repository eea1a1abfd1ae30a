"""Random forests: files, scores as one compiled expression, features from alignments, and training."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixforge.functions.sequence import reverse_complement
from helixforge.operators.align import REVERSE
from helixforge.options import Options


@dataclass(frozen=True)
class Node:
    """features[attribute] <= split goes left; a side is a probability (leaf) or another node."""

    attribute: int
    split: float
    left: Node | float
    right: Node | float


# --- files: u64 length and descriptor; u32 number of trees; for each u32 number of nodes, then nodes in preorder: u8
# attribute, f64 split, u8 flag (2: left is a leaf, 1: right is one), then the sides, leaves as f32; little-endian ---


def dump(trees: list[Node], descriptor: str) -> bytes:
    def node(x: Node) -> bytes:
        sides = [struct.pack("<f", s) if not isinstance(s, Node) else node(s) for s in (x.left, x.right)]
        flag = 2 * (not isinstance(x.left, Node)) + (not isinstance(x.right, Node))
        return struct.pack("<BdB", x.attribute, x.split, flag) + b"".join(sides)

    def size(x: Node) -> int:
        return 1 + sum(size(s) for s in (x.left, x.right) if isinstance(s, Node))

    name = descriptor.encode()
    return struct.pack("<Q", len(name)) + name + struct.pack("<I", len(trees)) + b"".join(struct.pack("<I", size(t)) + node(t) for t in trees)


def load(content: bytes, descriptor: str, most: int = 2**32 - 1) -> list[Node]:
    """At most `most` trees; another descriptor than the expected one is an error."""
    at = 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from("<" + form, content, at)
        at += struct.calcsize("<" + form)
        return out

    n = take("Q")[0]
    found = content[at : at + n].decode()
    at += n
    if found != descriptor:
        raise ValueError(f"the forest's features are {found!r}, expected {descriptor!r}")

    def node() -> Node:
        attribute, split, flag = take("BdB")
        left = take("f")[0] if flag & 2 else node()
        right = take("f")[0] if flag & 1 else node()
        return Node(attribute, split, left, right)

    trees = []
    for _ in range(min(take("I")[0], most)):
        take("I")
        trees.append(node())
    return trees


def load_file(spark, path: str, descriptor: str, most: int = 2**32 - 1) -> list[Node]:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return load(bytes(row["content"]), descriptor, most)


def _walk(side: Node | float, features: list[Column]) -> Column:
    if not isinstance(side, Node):
        return F.lit(float(side))
    return F.when(features[side.attribute] <= side.split, _walk(side.left, features)).otherwise(_walk(side.right, features))


def probability(trees: list[Node], features: list[Column]) -> Column:
    """The mean of the trees' leaves, as one expression for codegen; a null or missing feature goes right."""
    return sum((_walk(t, features) for t in trees[1:]), _walk(trees[0], features)) / len(trees)


def decide(trees: list[Node], features: list[Column], threshold: float) -> Column:
    """Whether the probability reaches the threshold."""
    return probability(trees, features) >= threshold


#: What anchor_features computes, in order; stands in the files of forests trained on them.
DESCRIPTOR = "support,coverage,orig_share,near_support,avg_support,min_support"


def anchor_features(cols: DataFrame, props: DataFrame, options: Options) -> DataFrame:
    """anchor_id, col, base and consensus, f (array of features) of the anchor's columns whose consensus is another letter."""
    from pyspark.sql import Window as Wd

    r = options.neighbor_region
    near = F.min("support").over(Wd.partitionBy("anchor_id").orderBy("col").rangeBetween(-r, r))
    own = cols.where("anchor_base is not null").withColumn("near", near).where("anchor_base <> consensus").join(props, "anchor_id")
    share = F.col("orig_weight") / (F.col("w_a") + F.col("w_c") + F.col("w_g") + F.col("w_t"))
    f = F.array(*[c.cast("double") for c in (F.col("support"), F.col("coverage"), share, F.col("near"), F.col("avg_support"), F.col("min_support"))])
    return own.select("anchor_id", "col", "anchor_base", "consensus", f.alias("f"))


def correct(cols: DataFrame, props: DataFrame, trees: list[Node], options: Options) -> DataFrame:
    """read_id, is_hq, sequence: like the rule-based anchors, but a letter changes where the forest says so."""
    featured = anchor_features(cols, props, options)
    yes = featured.where(decide(trees, [F.col("f")[i] for i in range(6)], options.threshold_anchor)).select("anchor_id", "col", F.lit(True).alias("yes"))
    own = cols.where("anchor_base is not null").select("anchor_id", "col", "anchor_base", "consensus").join(yes, ["anchor_id", "col"], "left").join(props.select("anchor_id", "is_hq"), "anchor_id")
    base = F.when(F.col("yes"), F.col("consensus")).otherwise(F.col("anchor_base"))
    pairs = F.struct("col", base.alias("base"))
    return own.groupBy(F.col("anchor_id").alias("read_id"), "is_hq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pairs)), lambda x: x["base"]), "").alias("sequence"))


#: What candidate_features computes.
CANDIDATE_DESCRIPTOR = "support,coverage,own_share,near_support,avg_support,min_support,overhang"


def candidate_features(found: DataFrame, cols: DataFrame, props: DataFrame, options: Options) -> DataFrame:
    """anchor_id, cand_id, orientation, col, base, consensus, f of every letter of the candidates that may be corrected (f is null
    where the letter is the consensus); base is the candidate's letter on the anchor's strand.  found: output of
    align.oriented.  The overhang is the part of the candidate that lies outside the anchor."""
    from pyspark.sql import Window as Wd

    n, r = options.new_columns_to_correct, options.neighbor_region
    hq = props.where("is_hq").select("anchor_id", "avg_support", "min_support")
    ends = cols.where("anchor_base is not null").groupBy("anchor_id").agg((F.max("col") + 1).alias("anchor_end"))
    size = F.length("sequence")
    some = found.join(hq, "anchor_id").join(ends, "anchor_id").withColumn("end", F.col("shift") + size)
    some = some.where((F.col("shift") >= -n) & (F.col("end") <= F.col("anchor_end") + n))
    outside = (F.greatest(-F.col("shift"), F.lit(0)) + F.greatest(F.col("end") - F.col("anchor_end"), F.lit(0))) / size
    each = some.select("anchor_id", "cand_id", "orientation", "shift", "sequence", "avg_support", "min_support", outside.alias("overhang"), F.explode(F.sequence(F.col("shift"), F.col("end") - 1)).alias("col"))
    near = F.min("support").over(Wd.partitionBy("anchor_id").orderBy("col").rangeBetween(-r, r))
    letters = cols.select("anchor_id", "col", "consensus", "support", "coverage", "w_a", "w_c", "w_g", "w_t", near.alias("near"))
    base = F.substr("sequence", F.col("col") - F.col("shift") + 1, F.lit(1))
    own = each.withColumn("base", base).join(letters, ["anchor_id", "col"])
    mine = F.coalesce(*[F.when(F.col("base") == b, F.col("w_" + b.lower())) for b in "ACGT"], F.lit(0))
    share = mine / (F.col("w_a") + F.col("w_c") + F.col("w_g") + F.col("w_t"))
    f = F.array(*[c.cast("double") for c in (F.col("support"), F.col("coverage"), share, F.col("near"), F.col("avg_support"), F.col("min_support"), F.col("overhang"))])
    return own.select("anchor_id", "cand_id", "orientation", "col", "base", "consensus", F.when(F.col("base") != F.col("consensus"), f).alias("f"))


def correct_candidates(featured: DataFrame, trees: list[Node], options: Options) -> DataFrame:
    """Output of candidate_features -> read_id, anchor_id, sequence: like the rule-based candidates, but a letter changes where the
    forest says so."""
    yes = F.col("f").isNotNull() & decide(trees, [F.get("f", F.lit(i)) for i in range(7)], options.threshold_candidates)
    pairs = F.struct("col", F.when(yes, F.col("consensus")).otherwise(F.col("base")).alias("base"))
    whole = featured.groupBy("anchor_id", "cand_id", "orientation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pairs)), lambda x: x["base"]), "").alias("s"))
    sequence = F.when(F.col("orientation") == REVERSE, reverse_complement(F.col("s"))).otherwise(F.col("s"))
    return whole.select(F.col("cand_id").alias("read_id"), "anchor_id", sequence.alias("sequence"))


def labelled(featured: DataFrame, perfect: DataFrame) -> DataFrame:
    """Features with y = 1 where the consensus is the true letter."""
    own = featured.join(perfect.select(F.col("read_id").alias("anchor_id"), "sequence"), "anchor_id")
    return own.select("f", (F.substr("sequence", F.col("col") + 1, F.lit(1)) == F.col("consensus")).cast("double").alias("y"))


def train(samples: DataFrame, kind: str = "forest", trees: int = 16, depth: int = 6, seed: int = 1):
    """Fits a classifier on f, y.  kind: forest or logistic -> (model, frame of predictions)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = samples.select(array_to_vector("f").alias("features"), F.col("y").alias("label"))
    fit = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed) if kind == "forest" else LogisticRegression(maxIter=50)
    model = fit.fit(data)
    return model, model.transform(data)


def judge(predictions: DataFrame) -> dict[str, float]:
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    own = BinaryClassificationEvaluator()
    return {"auroc": own.evaluate(predictions, {own.metricName: "areaUnderROC"}), "average_precision": own.evaluate(predictions, {own.metricName: "areaUnderPR"})}


def export(model) -> list[Node]:
    """The trees of a trained forest, for dump and for probability."""

    def node(x) -> Node | float:
        if x.numDescendants() == 0:
            stats = list(x.impurityStats().stats())
            return float(stats[1] / sum(stats)) if sum(stats) else 0.0
        return Node(x.split().featureIndex(), float(x.split().threshold()), node(x.leftChild()), node(x.rightChild()))

    roots = [node(t._call_java("rootNode")) for t in model.trees]
    return [r if isinstance(r, Node) else Node(0, 0.0, r, r) for r in roots]
