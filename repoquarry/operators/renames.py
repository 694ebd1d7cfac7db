"""Renames of changed files: line similarity of removed and added files, paired one to one."""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.functions.rows import unfold
from repoquarry.operators.skew import ordinals, spread_join
from repoquarry.session import cut_lineage, ship


def _line_weights(files: DataFrame) -> DataFrame:
    """`(repo_id, path, size, line, weight)`: each different line of a file and what all its occurrences weigh (characters and the end)."""
    lines = unfold(files.filter("content is not null"), ["repo_id", "path", (F.length("content") + 1).alias("size")], F.split("content", "\n"), "text")
    return lines.groupBy("repo_id", "path", "size", F.xxhash64("text").alias("line")).agg(F.sum(F.length("text") + 1).alias("weight"))


def similar_texts(gone: DataFrame, new: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """`(repo_id, old, new, similarity)` of the pairs of texts of a repository with a similarity of `threshold` or more, and the files of each
    text, `(repo_id, is_new, path, text)`. No such pair is missing, and copies of a text are compared once, however many they are.

    Both sides are `(repo_id, path, content)`. The similarity is the weight of the lines in common over that of the larger file. Candidates
    share one of the rarest lines of both: taken in one order of rarity, the first line in common leaves enough weight behind it in either
    text. So lines that many texts share (brackets, licenses) pair texts only where nothing rarer is left to decide, and those that
    still are hot are cut into places.
    """
    sides = _line_weights(gone).withColumn("is_new", F.lit(False)).unionByName(_line_weights(new).withColumn("is_new", F.lit(True)))
    every = cut_lineage(sides.filter("path is not null"))
    entries = F.sort_array(F.collect_list(F.concat_ws(" ", "size", "line", "weight")))
    files = cut_lineage(every.groupBy("repo_id", "is_new", "path").agg(F.md5(F.array_join(entries, ",")).alias("text")))
    one = files.groupBy("repo_id", "is_new", "text").agg(F.min("path").alias("path"))
    lines = cut_lineage(every.join(one, ["repo_id", "is_new", "path"]).drop("path"))
    uses = lines.groupBy("repo_id", "line").agg((F.count_if("is_new") * F.count_if(~F.col("is_new"))).alias("uses")).filter("uses > 0")
    rest = Window.partitionBy("repo_id", "is_new", "text").orderBy("uses", "line").rowsBetween(0, Window.unboundedFollowing)
    ranked = lines.join(uses, ["repo_id", "line"]).withColumn("left", F.sum("weight").over(rest))
    first = ranked.filter(F.col("left") >= F.col("size") * threshold).select("repo_id", "line", "is_new", "text", "size")
    old = first.filter(~F.col("is_new")).select("repo_id", "line", F.col("text").alias("old"), F.col("size").alias("old_size"))
    young = first.filter("is_new").select("repo_id", "line", F.col("text").alias("new"), F.col("size").alias("new_size"))
    near = F.least("old_size", "new_size") >= F.greatest("old_size", "new_size") * threshold
    pairs = spread_join(old, young, ["repo_id", "line"], "old", rows_per_place=10_000).filter(near)
    pairs = pairs.select("repo_id", "old", "new", F.greatest("old_size", "new_size").alias("size")).distinct()
    old_lines = lines.filter(~F.col("is_new")).select("repo_id", F.col("text").alias("old"), "line", F.col("weight").alias("old_weight"))
    new_lines = lines.filter("is_new").select("repo_id", F.col("text").alias("new"), "line", F.col("weight").alias("new_weight"))
    common = pairs.join(old_lines, ["repo_id", "old"]).join(new_lines, ["repo_id", "new", "line"])
    shared = common.groupBy("repo_id", "old", "new", "size").agg(F.sum(F.least("old_weight", "new_weight")).alias("common"))
    similar = shared.withColumn("similarity", F.col("common") / F.col("size")).filter(F.col("similarity") >= threshold)
    return similar.select("repo_id", "old", "new", "similarity"), files


def similar_files(gone: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """`(repo_id, old, new, similarity)` of the pairs of files that `similar_texts` finds, with all copies."""
    pairs, files = similar_texts(gone, new, threshold)
    for side, is_new in (("old", False), ("new", True)):
        ends = files.filter(F.col("is_new") == is_new).select("repo_id", F.col("text").alias(side), F.col("path").alias(f"{side}_path"))
        pairs = pairs.join(ends, ["repo_id", side])
    return pairs.select("repo_id", F.col("old_path").alias("old"), F.col("new_path").alias("new"), "similarity")


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """`match_texts` of pairs of files, each with a text of its own."""
    ends = [pairs.select("repo_id", F.lit(side == "new").alias("is_new"), F.col(side).alias("path"), F.col(side).alias("text")) for side in ("old", "new")]
    return match_texts(pairs, ends[0].unionByName(ends[1]).distinct())


def match_texts(pairs: DataFrame, files: DataFrame, rows_per_group: int = 1_000_000, rows_in_walk: int = 100_000) -> DataFrame:
    """`(repo_id, old, new, similarity)`, old and new being paths: the pairs of files a greedy choice takes, the most similar first, then those
    that keep their name, then by paths. Arguments as `similar_texts` returns them.

    Rounds over all tasks: texts whose nearest are each other, all with all, wait for nobody, so their files are paired by rank, those of one
    name first, however many copies they have. Where nearness ties texts in other ways, a pair of files that is the best of both is taken. The
    first round takes nearly all; what it leaves is chains of ties, a round for each link. So a repository with at most `rows_in_walk` pairs
    and files left is walked through in order by one task, and only larger ones go on in rounds, which end when no pair is left.
    """
    pairs = cut_lineage(pairs.groupBy("repo_id", "old", "new").agg(F.max("similarity").alias("similarity")))
    left, rounds = cut_lineage(_held(files, pairs)), []
    while True:
        edges = cut_lineage(_nearest(pairs, left))
        if edges.isEmpty():
            break
        taken = _by_rank(edges, left, rows_per_group)
        if not edges.filter("tight and not closed").isEmpty():
            taken = taken.unionByName(_mutual(edges, left))
        rounds.append(cut_lineage(taken))
        ends = [F.struct(F.lit(side == "new").alias("is_new"), F.col(side).alias("path")) for side in ("old", "new")]
        gone = rounds[-1].select("repo_id", F.explode(F.array(*ends)).alias("end")).select("repo_id", "end.*")
        left = cut_lineage(left.join(gone, ["repo_id", "is_new", "path"], "left_anti"))
        pairs = cut_lineage(_open(pairs, left))
        left = cut_lineage(_held(left, pairs))
        rows = pairs.select("repo_id").unionByName(left.select("repo_id")).groupBy("repo_id").agg(F.count("*").alias("_n"))
        small = cut_lineage(rows.filter(F.col("_n") <= rows_in_walk).select("repo_id"))
        rounds.append(cut_lineage(_walked(pairs.join(small, "repo_id", "left_semi"), left.join(small, "repo_id", "left_semi"))))
        pairs = pairs.join(small, "repo_id", "left_anti")
        if len(rounds) % 16 == 0:
            rounds = [cut_lineage(reduce(DataFrame.unionByName, rounds))]
    if rounds:
        return reduce(DataFrame.unionByName, rounds)
    return pairs.select("repo_id", "old", "new", "similarity")


def _held(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """The files whose texts are in a pair."""
    ends = [pairs.select("repo_id", F.lit(side == "new").alias("is_new"), F.col(side).alias("text")) for side in ("old", "new")]
    return files.join(ends[0].unionByName(ends[1]), ["repo_id", "is_new", "text"], "left_semi")


def _open(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """The pairs of texts that both have files left."""
    for side, is_new in (("old", False), ("new", True)):
        live = left.filter(F.col("is_new") == is_new).select("repo_id", F.col("text").alias(side))
        pairs = pairs.join(live, ["repo_id", side], "left_semi")
    return pairs


def _walked(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """The greedy choice in each repository, one after the other."""
    ship(pairs.sparkSession)
    schema = f"repo_id {pairs.schema['repo_id'].dataType.simpleString()}, old string, new string, similarity double"
    files = left.select(F.col("repo_id").alias("of"), "is_new", "path", "text")
    return pairs.groupBy("repo_id").cogroup(files.groupBy("of")).applyInArrow(_walk, schema)


def _walk(pairs: pa.Table, files: pa.Table) -> pa.Table:
    levels: dict[float, list[tuple[str, str]]] = defaultdict(list)
    for old, new, similarity in zip(*(pairs[c].to_pylist() for c in ("old", "new", "similarity")), strict=True):
        levels[similarity].append((old, new))
    texts: dict[tuple[bool, str], list[str]] = defaultdict(list)
    for is_new, path, text in sorted(zip(*(files[c].to_pylist() for c in ("is_new", "path", "text")), strict=True)):
        texts[is_new, text].append(path)
    used: dict[bool, set[str]] = {False: set(), True: set()}
    taken = []
    for similarity in sorted(levels, reverse=True):
        near = defaultdict(list)
        for old, new in levels[similarity]:
            near[old].append(new)
        for by_name in (True, False):
            # The paths of each new text (and name) in order, and for each old text (and name) a heap of the first ones not used.
            queues: dict[tuple[str, str], list[str]] = defaultdict(list)
            for text in {new for _, new in levels[similarity]}:
                for path in reversed(texts[True, text]):
                    if path not in used[True]:
                        queues[text, path.rpartition("/")[2] if by_name else ""].append(path)
            heaps: dict[tuple[str, str], list[tuple[str, str]]] = {}
            for path, old in sorted((p, old) for old in near for p in texts[False, old] if p not in used[False]):
                name = path.rpartition("/")[2] if by_name else ""
                if (old, name) not in heaps:
                    heaps[old, name] = [(queues[new, name][-1], new) for new in near[old] if queues.get((new, name))]
                    heapq.heapify(heaps[old, name])
                heap = heaps[old, name]
                while heap:
                    first, new = heap[0]
                    queue = queues[new, name]
                    if queue and queue[-1] == first:
                        queue.pop()
                        used[False].add(path)
                        used[True].add(first)
                        taken.append((path, first, similarity))
                        break
                    if queue:
                        heapq.heapreplace(heap, (queue[-1], new))
                    else:
                        heapq.heappop(heap)
    columns = [*zip(*taken, strict=True)] if taken else [(), (), ()]
    repo = pairs["repo_id"].to_pylist()[:1] * len(taken)
    types = [pairs.schema.field("repo_id").type, pa.string(), pa.string(), pa.float64()]
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("repo_id", "old", "new", "similarity"), (repo, *columns), types, strict=True)})


def _nearest(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """The pairs of texts with files left that are the nearest of either, `(repo_id, old, new, similarity, of_old, of_new, tight, closed, among)`.

    Tight pairs are the nearest of both texts. Closed ones belong to texts that are all tight with all of `among`, and with none else.
    """
    pairs = _open(pairs, left)
    by = {side: Window.partitionBy("repo_id", side) for side in ("old", "new")}
    tight = F.col("of_old") & F.col("of_new")

    def among(side: str, other: str) -> Column:
        """What tells one set of nearest texts from another: their number and 128 bits of their hashes."""
        bits = [F.bit_xor(F.when(F.col(f"of_{side}"), F.xxhash64(F.lit(seed), other))).over(by[side]) for seed in (1, 2)]
        return F.struct(F.count_if(F.col(f"of_{side}")).over(by[side]).alias("n"), bits[0].alias("x"), bits[1].alias("y"))

    def agrees(side: str, other: str) -> Column:
        """All nearest pairs of the text are tight, and their other ends have the same nearest texts."""
        theirs = F.when(F.col(f"of_{side}"), F.col(f"among_{other}"))
        whole = F.coalesce(F.bool_and(F.when(F.col(f"of_{side}"), tight)).over(by[side]), F.lit(False))
        return whole & (F.min(theirs).over(by[side]) == F.max(theirs).over(by[side]))

    edges = pairs.withColumn("of_old", F.col("similarity") == F.max("similarity").over(by["old"])).withColumn("among_old", among("old", "new"))
    edges = edges.withColumn("of_new", F.col("similarity") == F.max("similarity").over(by["new"])).withColumn("among_new", among("new", "old"))
    edges = edges.withColumn("new_agrees", agrees("new", "old")).withColumn("old_agrees", agrees("old", "new"))
    marked = edges.withColumns({"tight": tight, "closed": tight & F.col("old_agrees") & F.col("new_agrees")}).filter("of_old or of_new")
    return marked.select("repo_id", "old", "new", "similarity", "of_old", "of_new", "tight", "closed", F.col("among_old").alias("among"))


def _ranked(df: DataFrame, keys: list[str], rows_per_group: int) -> DataFrame:
    """The place of a path in its group; groups of more than `rows_per_group` rows are not sorted in one task."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_group).select(*keys)
    window = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    hot = cut_lineage(hot)
    if hot.isEmpty():
        return df.withColumn("rank", window)
    large = ordinals(df.join(F.broadcast(hot), keys, "left_semi"), keys, ["path"], "rank")
    return df.join(F.broadcast(hot), keys, "left_anti").withColumn("rank", window).unionByName(large.select(*df.columns, F.col("rank").cast("int")))


def _by_rank(edges: DataFrame, left: DataFrame, rows_per_group: int) -> DataFrame:
    """The files of closed pairs, paired by rank: those of the same name, then the others."""
    closed = edges.filter("closed")
    sides = [closed.select("repo_id", F.lit(side == "new").alias("is_new"), F.col(side).alias("text"), "among", "similarity").distinct() for side in ("old", "new")]
    ends = cut_lineage(left.join(sides[0].unionByName(sides[1]), ["repo_id", "is_new", "text"]).select("repo_id", "among", "similarity", "is_new", "path", F.substring_index("path", "/", -1).alias("name")))

    def paired(ends: DataFrame, keys: list[str]) -> DataFrame:
        sides = [F.max(F.when(F.col("is_new") == is_new, F.col("path"))).alias(side) for side, is_new in (("old", False), ("new", True))]
        return _ranked(ends, [*keys, "is_new"], rows_per_group).groupBy(*keys, "rank").agg(*sides)

    keys = ["repo_id", "among", "similarity"]
    named = cut_lineage(paired(ends, [*keys, "name"]))
    both = "old is not null and new is not null"
    others = named.filter(f"not ({both})").select(*keys, F.col("new").isNotNull().alias("is_new"), F.coalesce("old", "new").alias("path"))
    columns = ["repo_id", "old", "new", "similarity"]
    return named.filter(both).select(*columns).unionByName(paired(others, keys).filter(both).select(*columns))


def _mutual(edges: DataFrame, left: DataFrame) -> DataFrame:
    """Of the pairs that are not closed, the pairs of files that are the best of both."""
    open_edges = edges.filter("not closed")
    names = left.withColumn("name", F.substring_index("path", "/", -1))

    def best(side: str, other: str) -> DataFrame:
        nearest = open_edges.filter(f"of_{side}").select("repo_id", "similarity", F.col(side).alias("text"), F.col(other).alias("_other"))
        theirs = names.filter(F.col("is_new") == (other == "new")).withColumnRenamed("text", "_other")
        least = theirs.groupBy("repo_id", "_other", "name").agg(F.min("path").alias("path"))
        reach = nearest.join(least, ["repo_id", "_other"])
        named = reach.groupBy("repo_id", "text", "name").agg(F.min("path").alias("_named"))
        whole = reach.groupBy("repo_id", "text", "similarity").agg(F.min("path").alias("_first"))
        mine = names.filter(F.col("is_new") == (side == "new"))
        found = mine.join(whole, ["repo_id", "text"]).join(named, ["repo_id", "text", "name"], "left")
        return found.select("repo_id", F.col("path").alias(side), F.coalesce("_named", "_first").alias(other), "similarity")

    return best("old", "new").join(best("new", "old"), ["repo_id", "old", "new", "similarity"])


def pair_changed(changes: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """The changes with removed and added files of a similarity of `threshold` or more made into renames. `a` and `b` hold the contents."""
    changes = cut_lineage(changes)

    def texts(files: DataFrame, kind: str) -> DataFrame:
        keys = changes.filter(F.col("change_type") == kind).select("repo_id", F.col("file_path").alias("path"))
        return files.select("repo_id", "path", "content").join(keys, ["repo_id", "path"], "left_semi")

    moved = match_texts(*similar_texts(texts(a, "D"), texts(b, "A"), threshold))
    ends = moved.select("repo_id", F.col("old").alias("file_path"), F.lit("D").alias("change_type")).unionByName(
        moved.select("repo_id", F.col("new").alias("file_path"), F.lit("A").alias("change_type"))
    )
    renames = moved.select("repo_id", F.col("new").alias("file_path"), F.lit("R").alias("change_type"), F.col("old").alias("old_path"), "similarity")
    return changes.join(ends, ["repo_id", "file_path", "change_type"], "left_anti").select(*renames.columns).unionByName(renames)
