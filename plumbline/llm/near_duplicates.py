"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct 5-word shingles; two are linked if their Jaccard similarity is at least
``percent``/100, confirmed on the full sets. Documents of equal sets form one class by a 128-bit fingerprint
first, so exact copies cost one row. The join then grows independent trees over the classes:

* A tree's first level sends every class to the node of its smallest shingle under the tree's hash.
* A node of at most ``leaf`` classes is compared exhaustively.
* A larger node (in classes, or in shingles altogether) branches: two coordinates, chosen by its root's hash and never twice on
  a path, send each class to the child of its minwise shingle there. If one child would hold 85 % of the node, the classes are so
  alike that branching parts them too slowly: the node is a crowd, as is every node that is still large after ``depth`` levels.
* A crowd is compared with 32 pivots of its own first, block by block. After the last tree, only classes outside a crowd's
  main component are compared with all of it, in pairs of blocks of bounded size. A crowd of near copies
  costs about as many rows as it has classes, and nothing is capped.

A pair of similarity s meets in one tree with probability s * (1 - (1 - s)^2)^levels, so trees repeat to the
target: with 8 trees a pair at 0.85 is missed with probability under 6e-5 even where all 8 levels are needed. Trees grow in two rounds. The first
round's components let the second skip every node that lies within one component. Nodes with equal
member sets are compared once. A comparison emits a spanning forest of its links, never all pairs.

Defined results: null or wordless texts have no shingles and link with nothing; a null doc_id has a null component and
is kept; rows that share a doc_id are one document to the components, and each gets a row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .components import components
from .shared import Scope, Sieve, gathered, respread, table, unused

COORDINATES = 16


def _salts(n: int) -> np.ndarray:
    return textbytes.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def signatures(df: DataFrame, doc_id: str, text: str, k: int, trees: int) -> DataFrame:
    """id, n, f1, f2, top, sig: set size, fingerprint, minwise hashes of the first levels and of COORDINATES more."""
    kind = df.schema[doc_id].dataType.simpleString()
    salts = _salts(trees + COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                sets, at = textbytes.shingles(textbytes.Words(batch.column(1)), k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                f = np.zeros((2, len(n)), np.int64)
                sig = np.zeros((len(full), len(salts)), np.int64)
                if len(full):
                    starts = at[full]
                    f[0, full] = np.add.reduceat(textbytes.mix(sets), starts).view(np.int64)
                    f[1, full] = np.add.reduceat(textbytes.mix(sets ^ np.uint64(0x1B873593CC9E2D51)), starts).view(np.int64)
                    for j, salt in enumerate(salts):
                        v = (sets ^ salt) * np.uint64(0x9E3779B97F4A7C15)
                        v ^= v >> np.uint64(29)
                        v *= np.uint64(0xBF58476D1CE4E5B9)
                        sig[:, j] = np.minimum.reduceat(v, starts).view(np.int64)
                lists = []
                for part in (sig[:, :trees], sig[:, trees:]):
                    edges = np.concatenate([[0], np.cumsum(np.where(n > 0, part.shape[1], 0))])
                    lists.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(part.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f[0]), pa.array(f[1]), *lists], ["id", "n", "f1", "f2", "top", "sig"])

    return df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, top array<long>, sig array<long>")


def _nodes(rows: DataFrame) -> DataFrame:
    """node, size, weight of the nodes worth comparing: two classes of two components at least, one node for each set of members."""
    n = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("c")).alias("x"),
        F.sum(F.shiftright(F.xxhash64("c", F.lit(1)), 24)).alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
    )
    n = n.filter((F.col("size") > 1) & (F.col("lo") < F.col("hi")))
    return n.groupBy("size", "weight", "x", "s").agg(F.min("node").alias("node")).select("node", "size", "weight")


def _members(rows: DataFrame) -> DataFrame:
    """node, origin, c, n, size, weight of all classes in the nodes worth comparing."""
    kept = gathered(_nodes(rows)).withColumnRenamed("node", "k")
    return table(gathered(rows.select("node", "origin", "c", "n").join(kept, F.col("node") == F.col("k")).drop("k")), "members")


def _grow(rows: DataFrame, docs: DataFrame, comps: DataFrame | None, leaf: int, most: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Small nodes to compare exhaustively and crowds (None: there are none), as (node, c, n), from the first level's rows (node, origin, c, n, comp)."""
    ready, crowds = [], []
    small = (F.col("size") <= leaf) & (F.col("weight") <= most)
    for level in range(depth + 1):
        members = _members(rows)
        ready.append(members.filter(small).select("node", "c", "n"))
        big = members.filter(~small)
        if big.isEmpty():
            break
        if level == depth:
            crowds.append(big.select("node", "c", "n"))
            break
        stride = F.shiftleft(F.pmod(F.xxhash64("origin", F.lit(1)), F.lit(COORDINATES // 2)), 1) + 1
        pick = lambda j: F.pmod(F.xxhash64("origin") % COORDINATES + (2 * level + j) * stride, F.lit(COORDINATES)).cast("int")  # noqa: B023, E731
        with_sig = big.join(docs.select(F.col("id").alias("c2"), "sig"), F.col("c") == F.col("c2"))
        child = lambda j: F.xxhash64("node", pick(j), F.element_at("sig", pick(j) + 1))  # noqa: B023, E731
        grown = table(gathered(with_sig.select("node", "origin", "c", "n", "size", F.explode(F.array(child(0), child(1))).alias("child")).distinct()), "grown")
        widest = grown.groupBy("node", "child", "size").count().groupBy("node").agg(F.max(F.col("count") / F.col("size")).alias("share"))
        dense = table(gathered(widest.filter(F.col("share") >= 0.85).select(F.col("node").alias("k"))), "dense")
        crowds.append(big.join(dense, F.col("node") == F.col("k"), "left_semi").select("node", "c", "n"))
        rows = grown.join(dense, F.col("node") == F.col("k"), "left_anti").select(F.col("child").alias("node"), "origin", "c", "n").distinct()
        rows = _with_component(rows, comps)
    return reduce(DataFrame.union, ready), reduce(DataFrame.union, crowds) if crowds else None


def _apart(crowds: DataFrame, comps: DataFrame | None, leaf: int, most: int) -> DataFrame:
    """node, c, out, nb, ns of the crowds that are not one component yet: out tells who is outside the main one; numbers of blocks of all and of those."""
    rows = _with_component(crowds, comps)
    parts = table(rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).transform(gathered), "crowd-parts")
    nodes = parts.groupBy("node").agg(F.max(F.struct("size", "weight", "comp")).alias("main"), F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    nodes = nodes.filter(F.col("main.size") < F.col("size"))
    blocks = lambda size, weight: F.greatest(F.ceil(size / (2 * leaf)), F.ceil(weight / most)).cast("int")
    nodes = nodes.select(
        F.col("node").alias("k"), F.col("main.comp").alias("main"), blocks(F.col("size"), F.col("weight")).alias("nb"),
        blocks(F.col("size") - F.col("main.size"), F.col("weight") - F.col("main.weight")).alias("ns"),
    )
    rows = rows.join(gathered(nodes), F.col("node") == F.col("k"))
    return table(gathered(rows.select("node", "c", (F.col("comp") != F.col("main")).alias("out"), "nb", "ns")), "crowds")


def _block(count: str) -> Column:
    return F.pmod(F.xxhash64("c"), F.col(count)).cast("int")


def _pivoted(apart: DataFrame, pivots: int = 32) -> DataFrame:
    """Groups (node, c): every block of a crowd with the crowd's pivots, which are taken from the classes outside the main component."""
    deal = F.xxhash64("c", "node", F.lit(11))
    chosen = apart.filter("out").groupBy("node", "nb", F.pmod(deal, F.lit(pivots)).alias("slot")).agg(F.min_by("c", deal).alias("c"))
    chosen = chosen.select("node", "c", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    return apart.select("node", "c", _block("nb").alias("b")).union(chosen).select(F.xxhash64("node", "b").alias("node"), "c").distinct()


def _crossed(apart: DataFrame) -> DataFrame:
    """Groups (node, c): every block of a crowd with every block of the classes outside its main component."""
    every = apart.select("node", "c", _block("nb").alias("b"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("o"))
    out = apart.filter("out").select("node", "c", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), _block("ns").alias("o"))
    return every.union(out).select(F.xxhash64("node", "b", "o").alias("node"), "c").distinct()


def _with_component(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("c"))
    return rows.join(comps.select(F.col("id").alias("i"), "root"), F.col("c") == F.col("i"), "left").select(*rows.columns, F.coalesce("root", "c").alias("comp"))


def _forest(sets: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's sets."""
    n = len(at) - 1
    size = np.diff(at)
    if n == 2:
        links = [(0, 1, len(np.intersect1d(sets[at[0] : at[1]], sets[at[1] : at[2]], assume_unique=True)))]
        links = [(i, j) for i, j, common in links if 100 * common >= percent * (size[0] + size[1] - common)]
    else:
        who = np.repeat(np.arange(n), size)
        _, code, times = np.unique(sets, return_inverse=True, return_counts=True)
        shared = times[code] > 1
        who, code = who[shared], np.unique(code[shared], return_inverse=True)[1]
        common = np.zeros((n, n), np.float32)
        order = np.argsort(code, kind="stable")
        who, code = who[order], code[order]
        for begin in range(0, int(code[-1]) + 1 if len(code) else 0, 8192):
            a, b = np.searchsorted(code, [begin, begin + 8192])
            part = np.zeros((n, min(8192, int(code[-1]) + 1 - begin)), np.float32)
            part[who[a:b], code[a:b] - begin] = 1
            common += part @ part.T
        count = np.rint(common).astype(np.int64)
        linked = 100 * count >= percent * (size[:, None] + size[None, :] - count)
        links = np.argwhere(np.triu(linked, 1)).tolist()
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def _compare(groups: DataFrame, texts: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """Links a, b found in the groups (node, c)."""
    rows = groups.join(texts.hint("merge"), F.col("c") == F.col("id")).select("node", "c", "f1", "text")
    rows = rows.repartition("node").sortWithinPartitions("node")

    def links_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple] = []
        ids = batch.column(1).to_pylist()
        id_type = pa.string() if pa.types.is_large_string(batch.column(1).type) else batch.column(1).type
        node = batch.column(0).to_numpy()
        sets, at = textbytes.shingles(textbytes.Words(batch.column(3)), k)
        full = np.flatnonzero(np.diff(at))
        same = np.zeros(batch.num_rows, np.bool_)  # another text under the same id is no member of the class
        if len(full):
            same[full] = np.add.reduceat(textbytes.mix(sets), at[full]).view(np.int64) == batch.column(2).to_numpy()[full]
        edges = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(node)), strict=True):
            rows_ = [i for i in range(a, b) if same[i]]
            once = list({ids[i]: i for i in reversed(rows_)}.values())
            if len(once) > 1:
                parts = [sets[at[i] : at[i + 1]] for i in once]
                found += [(ids[once[i]], ids[once[j]]) for i, j in _forest(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), percent)]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], id_type), pa.array([f[1] for f in found], id_type)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            node = batch.column(0).to_numpy()
            changes = np.flatnonzero(node[1:] != node[:-1]) + 1
            begin = 0
            for c in [*changes.tolist(), len(node)]:
                piece = batch.slice(begin, c - begin)
                enough = sum(h.num_rows for h in held) >= 256 or sum(h.nbytes for h in held) >= 32 << 20
                if held and held[-1].column(0)[-1] != piece.column(0)[0] and enough:
                    yield links_of(_join(held))
                    held = []
                held.append(piece)
                begin = c
        if held:
            yield links_of(_join(held))

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _join(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch; texts with 64-bit offsets, as one string column over 2 GiB stays in several chunks."""
    whole = pa.Table.from_batches(pieces)
    wide = [f.with_type(pa.large_string()) if pa.types.is_string(f.type) else f for f in whole.schema]
    (batch,) = whole.cast(pa.schema(wide)).combine_chunks().to_batches()
    return batch


def near_duplicates(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 85, trees: tuple[int, int] = (3, 5), leaf: int = 512, most: int = 4_000_000, depth: int = 8
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``df``."""
    kind = df.schema[doc_id].dataType.simpleString()
    total = sum(trees)
    with Scope() as scope:
        docs = table(signatures(df, doc_id, text, k, total), "signatures")
        classes = docs.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("f1", "f2").agg(F.min("id").alias("c"), F.first("top").alias("top"), F.first("n").alias("n"))
        classes = table(gathered(classes), "classes")
        rows = classes.select("c", "n", F.posexplode("top").alias("tree", "m")).select("tree", F.xxhash64("tree", "m").alias("node"), "c", "n")
        # The texts of all classes that meet another one somewhere, taken from the corpus once.
        met = _nodes(_with_component(rows.select("node", "c", "n"), None)).select(F.col("node").alias("k"))
        wanted = rows.join(gathered(met), F.col("node") == F.col("k"), "left_semi").select(F.col("c").alias("w")).distinct()
        wanted = wanted.join(classes.select("c", "f1"), F.col("w") == F.col("c")).select("w", "f1")
        source = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        wanted = table(gathered(wanted), "wanted")
        source = Sieve(wanted.select("w")).passed(source, F.col("id"))
        # Joins with texts are sort-merge joins at every size: what a small input could broadcast grows with the data.
        texts = table(source.join(respread(wanted).hint("merge"), F.col("id") == F.col("w")).select("id", "f1", "text"), "texts")

        comps, crowds = None, []

        def meet(groups: DataFrame, comps: DataFrame | None) -> DataFrame:
            links = _compare(groups, texts, k, percent, kind)
            return components(links if comps is None else links.union(comps.select("id", "root")))

        for low, high in ((0, trees[0]), (trees[0], total)):
            part = _with_component(rows.filter((F.col("tree") >= low) & (F.col("tree") < high)).select("node", F.col("node").alias("origin"), "c", "n"), comps)
            groups, crowd = _grow(part, docs, comps, leaf, most, depth)
            groups = groups.select("node", "c")
            if crowd is not None:
                crowds.append(table(gathered(crowd), "crowded"))
                groups = groups.union(_pivoted(_apart(crowds[-1], comps, leaf, most)))
            comps = meet(groups, comps)
        if crowds:
            apart = _apart(reduce(DataFrame.union, crowds), comps, leaf, most)
            if not apart.isEmpty():
                comps = meet(_crossed(apart), comps)
        scope.keep(docs, classes, comps)
    roots = comps.select(F.col("id").alias("c2"), F.col("root"))
    cls = classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "c").join(roots, F.col("c") == F.col("c2"), "left")
    cls = respread(cls.select("g1", "g2", F.coalesce("root", "c").alias("component_id")))
    out = docs.select("id", "n", "f1", "f2").join(cls, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df`` that stay: one document of each group of near copies. Columns of any name pass through."""
    key = unused(df, "gone")
    gone = near_duplicates(df, doc_id=doc_id, text=text, percent=percent).filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return df.join(respread(gone), F.col(doc_id) == F.col(key), "left_anti")
