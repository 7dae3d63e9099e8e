"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Each text gives a set of hashed five-word shingles, a digest of that set and
   a MinHash signature.  Texts of equal sets are one node from here on.
2. The forest has TREES sorted orders; the sort key of an order is its own run
   of signature values.  A range partitioning that ends in the id cuts even a
   huge group of alike texts into equal parts.
3. In each order the rows next to a row are those with the longest common
   prefix.  Rows within WINDOW places that share MIN_DEPTH values, whose sizes
   allow the similarity and whose signatures agree well enough are candidates;
   they form blocks.  The same block from several orders counts once.
4. The full shingle sets of a block's texts meet in one task, which finds all
   exact intersections in the block and reports links that span what is linked.
   A block has at most BLOCK rows and, of more than two, BLOCK_SHINGLES shingles.
5. Components of the links give the classes so far.
6. A region where more rows than a window share MIN_DEPTH values, or that a
   partition's end may part, is held against itself in whole, unless it is one
   class already.  A region of more than MOST_ROWS rows is first divided by
   the next value, and so on to DEPTH values: depth adapts to each region.
   Its rows are dealt into parts of about PART rows, each two parts meet in one
   task, and rows of different classes that agree well enough and met in no
   earlier order form further blocks.  Components of all links give the classes.

Nothing is capped: any two texts that share a region of any order and whose
signatures agree are compared exactly or linked by others.  A row meets at
most MOST_ROWS others in an order, save in regions that DEPTH values do not
divide, which are held against themselves in whole.  At the similarity of 0.75
two texts share MIN_DEPTH values of one order with probability 0.56, of one of
twelve with 0.99995; where regions are divided down to 3, 4, 5 and 6 values it
is 0.999, 0.99, 0.95 and 0.90, and more for more similar texts.  An estimate from
128 signature values is let through from 0.60, 3.7 standard errors below 0.75.

Cases: a text with fewer than five words is one shingle; an empty, blank or
null text has no shingle and is linked with nothing; rows that repeat an id
are one document, whose texts are in one class; a row without an id is kept and
never linked; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _words
from .components import components

SHINGLE = 5
NUMBER, OF = 75, 100  #: linked if OF * intersection >= NUMBER * union
TREES, DEPTH, STRIDE = 12, 6, 10
VALUES = 128  #: signature values; order t starts at value STRIDE * t
MIN_DEPTH = 2
WINDOW, BLOCK, TILE = 64, 256, 128
BLOCK_SHINGLES = 4 << 20
PART = 1024  #: rows of a region that are held against as many others in one task
MOST_ROWS = 8 * PART  #: rows of a region that is not divided
LABEL = 1 + 2 * DEPTH  #: bytes of a label: the order and its values
HEAD = 1 + 2 * MIN_DEPTH  #: those that name its region
HOT_SHARE = 4096  #: shingle sets of more than one row in so many are joined apart
AGREE = 0.60 + 0.40 / 16  #: of 4-bit values, one in sixteen of which agrees by chance


def _hasher() -> _words.Hasher:
    return _words.Hasher(_words.white_space(), lower_ascii=True)


def _shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of one text's word hashes, sorted."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, SHINGLE)
    joined = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i]
    return np.unique(_words.mix(joined))


def shingle_sets(texts):
    """The sorted shingle hashes of each whole text."""
    for _, counts, starts, ends, stretch in _hasher().chunks(texts):
        words, limits = stretch(starts, ends), np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(counts)):
            yield _shingles(words[limits[i] : limits[i + 1]])


def signature(shingles: np.ndarray, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 32 bits."""
    least = np.full(len(factors), np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096]
        np.minimum(least, (part * factors[:, None] + addends[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(frames):
    rng = np.random.default_rng(29)
    factors = rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
    addends = rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
    packer = zstandard.ZstdCompressor(level=3)
    for pdf in frames:
        rows = []
        for text, found in zip(pdf["text"], shingle_sets(pdf["text"])):
            if not len(found):
                rows.append((0, None, None, None, None))
                continue
            sig = signature(found, factors, addends)
            labels = b"".join(
                bytes([t]) + (sig[STRIDE * t : STRIDE * t + DEPTH] >> np.uint32(16)).astype(">u2").tobytes() for t in range(TREES)
            )
            low = (sig & np.uint32(15)).astype(np.uint8)
            digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            rows.append(
                (len(found), digest, labels, (low[::2] << 4 | low[1::2]).tobytes(), packer.compress(text.encode("utf-8", "surrogatepass")))
            )
        yield pd.DataFrame({"doc_id": pdf["doc_id"]}).join(
            pd.DataFrame(rows, columns=["n_shingles", "digest", "labels", "bits", "packed"], index=pdf.index)
        )


def _blocks(frames):
    """Blocks of ids from one part of one sorted order after another, and the
    regions that are longer than a window or touch the part's ends.

    A part is scanned in pieces that overlap by WINDOW rows.
    """
    held, first = pd.DataFrame(), True
    for pdf in frames:
        if first and len(pdf):
            first = False
            yield _marks([pdf["label"].iloc[0]])
        held = pd.concat([held, pdf], ignore_index=True)
        if len(held) >= 16384:
            yield from (_scan(held), _long(held))
            held = held.tail(WINDOW)
    yield from (_scan(held), _long(held))
    if len(held):
        yield _marks([held["label"].iloc[-1]])


def _marks(labels) -> pd.DataFrame:
    found = sorted({bytes(x[:HEAD]) for x in labels})
    return pd.DataFrame(
        {"block": pd.Series([None] * len(found), dtype=object), "doc_id": pd.Series([pd.NA] * len(found), dtype="Int64"), "region": found}
    )


def _long(rows: pd.DataFrame) -> pd.DataFrame:
    """Regions with rows that are WINDOW places apart."""
    heads = [x[:HEAD] for x in rows["label"]] if len(rows) else []
    return _marks({a for a, b in zip(heads, heads[WINDOW:]) if a == b})


def _agreeing(rows: pd.DataFrame) -> np.ndarray:
    """The 4-bit signature values of rows, a row each."""
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), VALUES // 2)
    return np.concatenate([bits >> 4, bits & 15], 1)


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return OF * np.minimum(a, b) >= NUMBER * np.maximum(a, b)


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    n, found = len(rows), []
    if n > 1:
        ids, sizes, bits = rows["doc_id"].to_numpy(), rows["n_shingles"].to_numpy(), _agreeing(rows)
        top = np.frombuffer(b"".join(x[:HEAD].ljust(8) for x in rows["label"]), ">u8")
        pairs, reach = [], np.zeros(n + 1, np.int32)
        for s in range(1, min(WINDOW, n - 1) + 1):
            near = np.flatnonzero(top[s:] == top[:-s])
            if not len(near):
                break
            near = near[_sizes_allow(sizes[near], sizes[near + s])]
            near = near[(bits[near] == bits[near + s]).sum(1) >= AGREE * VALUES]
            pairs.append(np.stack([near, near + s], 1))
            np.add.at(reach, near, 1)
            np.add.at(reach, near + s, -1)
        pairs = np.concatenate([np.zeros((0, 2), int), *pairs])
        # a run of rows, each of which is joined to the next by a pair that spans both
        run = np.cumsum(np.cumsum(reach)[:n] == 0)
        run = run - (np.cumsum(reach)[:n] == 0)
        pairs = pairs[np.argsort(run[pairs[:, 0]], kind="stable")]
        for own in np.split(pairs, np.flatnonzero(np.diff(run[pairs[:, 0]])) + 1):
            if len(own):
                found += [ids[x] for x in _cover(own, sizes)]
    return _named(found)


def _named(blocks: list[np.ndarray]) -> pd.DataFrame:
    """(block, doc_id) rows; a block is named by its members."""
    blocks = [x for x in map(np.unique, blocks) if len(x) > 1]
    names = [hashlib.blake2b(x.tobytes(), digest_size=12).hexdigest() for x in blocks]
    ids = np.concatenate([np.zeros(0, np.int64), *blocks])
    return pd.DataFrame({"block": np.repeat(np.array(names, object), [len(x) for x in blocks]), "doc_id": ids, "region": None})


def _cover(pairs: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Blocks of rows that hold every pair (left, right) between them: all rows
    at once if they fit, else tiles of TILE by TILE rows, put together as far as
    a block allows and divided where their shingles are too many."""
    fits = lambda rows: len(rows) <= 2 or len(rows) <= BLOCK and sizes[rows].sum() <= BLOCK_SHINGLES
    members = np.unique(pairs)
    if fits(members):
        return [members]
    tile = np.searchsorted(members, pairs) // TILE
    order = np.lexsort((tile[:, 1], tile[:, 0]))
    pairs, tile = pairs[order], tile[order]
    out, held = [], None
    waiting = [x for x in np.split(pairs, np.flatnonzero((np.diff(tile, axis=0) != 0).any(1)) + 1)][::-1]
    while waiting:
        own = waiting.pop()
        rows = np.unique(own)
        if not fits(rows):  # in two by the side with more rows
            side = 0 if len(np.unique(own[:, 0])) >= len(np.unique(own[:, 1])) else 1
            own = own[np.argsort(own[:, side], kind="stable")]
            values = np.unique(own[:, side])
            cut = np.searchsorted(own[:, side], values[len(values) // 2])
            waiting += [own[cut:], own[:cut]] if 0 < cut < len(own) else [own[1:], own[:1]]
            continue
        both = rows if held is None else np.union1d(held, rows)
        if held is not None and not fits(both):
            out.append(held)
            both = rows
        held = both
    return [*out, held]


def exact_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (i, j) with OF * intersection >= NUMBER * union that span all that
    such pairs link, from exact intersections of all the sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    often = np.bincount(column)[column] > 1
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    common = np.zeros((n, n))
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, 8192):
        i, j = np.searchsorted(column, [a, a + 8192])
        held = np.zeros((n, min(8192, width - a)), np.float32)
        held[owner[i:j], column[i:j] - a] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    left, right = np.nonzero(np.triu(OF * common >= NUMBER * union, 1))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((i, j))
    return links


def _confirm(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id")
    ids, opener = pdf["doc_id"].to_numpy(), zstandard.ZstdDecompressor()
    sets = list(shingle_sets(opener.decompress(x).decode("utf-8", "surrogatepass") for x in pdf["packed"]))
    links = exact_links(sets)
    return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}).astype("int64")


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of the rows of two parts of a region (or of one) that may be linked with rows of another class."""
    region, width, n = pdf["region"].iloc[0], int(pdf["width"].iloc[0]), len(pdf)
    pdf = pdf.sort_values(["component", "doc_id"], ignore_index=True)
    ids, sizes, bits = pdf["doc_id"].to_numpy(), pdf["n_shingles"].to_numpy(), _agreeing(pdf)
    agreed = np.zeros((n, n), np.float32)
    for value in range(16):
        of = (bits == value).astype(np.float32)
        agreed += of @ of.T
    classes, side = pdf["component"].to_numpy(), pdf["side"].to_numpy()
    open_ = np.triu(agreed >= AGREE * VALUES, 1)
    del agreed
    open_ &= classes[:, None] != classes[None, :]
    one, other = pdf["pair"].iloc[0].split(":")
    if one != other:  # each part alone is another task's
        open_ &= side[:, None] != side[None, :]
    pairs = np.argwhere(open_)
    pairs = pairs[_sizes_allow(sizes[pairs[:, 0]], sizes[pairs[:, 1]])]
    heads = np.frombuffer(b"".join(pdf["heads"]), np.uint8).reshape(n, TREES, width)
    for before in range(region[0]):  # what shares a region of an earlier order has met there
        pairs = pairs[~(heads[pairs[:, 0], before] == heads[pairs[:, 1], before]).all(1)]
    return _named([ids[x] for x in _cover(pairs, sizes)] if len(pairs) else [])[["block", "doc_id"]]


def _across(nodes: DataFrame, regions: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks (block, doc_id) of rows of different classes within the given regions.

    Until the regions of several classes are known, rows are ids and labels; the
    signatures come in last.  A class that has PART rows of a region is dealt into
    parts of its own, which need not meet one another."""
    label = F.explode(F.array(*[F.substring("labels", 1 + LABEL * t, LABEL) for t in range(TREES)])).alias("label")
    rows = nodes.select("doc_id", label).withColumn("region", F.substring("label", 1, HEAD)).join(regions, "region", "left_semi")
    rows = rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = _shared.written(rows, "regions")
    width = HEAD
    for depth in range(MIN_DEPTH + 1, DEPTH + 1):
        large = rows.groupBy("region").count().where(F.col("count") > MOST_ROWS).select("region", F.lit(True).alias("large"))
        if not large.take(1):
            break
        # those of a region that is divided need not have met by their first values
        deeper = F.when(F.col("large"), F.substring("label", 1, 1 + 2 * depth)).otherwise(F.col("region"))
        rows, before = _shared.written(rows.join(large, "region", "left").withColumn("region", deeper).drop("large"), "regions"), rows
        _shared.remove(before)
        width = LABEL
    sizes = rows.groupBy("region", "component").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= PART, F.struct(F.col("component").alias("own"), F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    few = F.sum(F.when(F.col("n") < PART, F.col("n")))
    of = sizes.groupBy("region").agg(F.count("*").alias("classes"), F.array_compact(F.collect_list(own)).alias("large"), few.alias("few"))
    of = of.where("classes > 1").select("region", "large", F.coalesce(F.ceil(F.col("few") / PART), F.lit(0)).cast("int").alias("parts"))
    rows = rows.join(_shared.written(of, "parts"), "region").select("doc_id", "component", "region", "large", "parts")
    heads = F.concat(*[F.substring("labels", 1 + LABEL * t, width) for t in range(TREES)])
    wide = nodes.select("doc_id", "n_shingles", "bits", heads.alias("heads"))
    rows = rows.join(wide.hint("merge"), "doc_id").select("*", F.explode(_groups()).alias("g"))
    rows = rows.select("region", "g.*", F.lit(width).alias("width"), "doc_id", "n_shingles", "component", "bits", "heads")
    return rows.groupBy("region", "pair").applyInPandas(_meet, "block string, doc_id long").distinct()


def _groups() -> F.Column:
    """array(struct(pair, side)): where a row meets others, by its region's large
    classes and number of parts.  Parts are named by class (-, if none) and number."""
    mine = F.filter("large", lambda x: x["own"] == F.col("component"))
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    here = F.when(F.size(mine) > 0, F.concat(F.col("component").cast("string"), F.lit("."), deal(mine[0]["parts"]).cast("string")))
    here = F.coalesce(here, F.concat(F.lit("-."), deal(F.col("parts")).cast("string")))
    plain = F.transform(upto(F.col("parts")), lambda i: F.concat(F.lit("-."), i.cast("string")))
    named = lambda x: F.transform(upto(x["parts"]), lambda i: F.concat(x["own"].cast("string"), F.lit("."), i.cast("string")))
    others = F.flatten(F.transform(F.filter("large", lambda x: x["own"] != F.col("component")), named))
    met = lambda other: F.struct(
        F.concat_ws(":", F.least(here, other), F.greatest(here, other)).alias("pair"), (here > other).cast("int").alias("side")
    )
    return F.transform(F.concat(plain, others), met)


def _repeated(sketches: DataFrame) -> DataFrame:
    """(doc_id, several): the ids of more than one row, and whether their texts differ."""
    digest = F.coalesce("digest", F.lit(b""))
    own = (
        sketches.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), (F.min(digest) != F.max(digest)).alias("several"))
    )
    return _shared.written(own.where("n > 1").select("doc_id", "several"), "repeated")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text)."""
    schema = "doc_id long, n_shingles long, digest binary, labels binary, bits binary, packed binary"
    sketches = _shared.written(_shared.map_frames(docs.select(F.col("doc_id").cast("long"), "text"), _sketch, schema), "sketches")
    linkable = sketches.where("n_shingles > 0 and doc_id is not null")
    firsts = _shared.written(linkable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "firsts")
    repeated = _repeated(sketches)
    once = (lambda df: df.dropDuplicates()) if repeated.take(1) else (lambda df: df)
    heads = firsts.select("digest", F.col("node").alias("doc_id")).hint("merge")
    nodes = linkable.select("doc_id", "digest", "n_shingles", "labels", "bits").join(heads, ["digest", "doc_id"], "left_semi")
    nodes = _shared.written(once(nodes).drop("digest"), "nodes")
    labels = F.explode(F.array(*[F.substring("labels", 1 + LABEL * t, LABEL) for t in range(TREES)])).alias("label")
    rows = (
        nodes.select("doc_id", "n_shingles", "bits", labels)
        .repartitionByRange("label", "doc_id")
        .sortWithinPartitions("label", "doc_id")
    )
    blocks = _shared.written(rows.mapInPandas(_blocks, "block string, doc_id long, region binary").distinct(), "blocks")

    def links(blocks: DataFrame) -> DataFrame:
        texts = linkable.select("doc_id", "packed").join(blocks.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        return blocks.join(once(texts).hint("merge"), "doc_id").groupBy("block").applyInPandas(_confirm, "a long, b long")

    several = repeated.where("several").select("doc_id")
    ties = linkable.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(firsts.hint("merge"), "digest")
    ties = ties.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links(blocks.where("block is not null").select("block", "doc_id")).unionByName(ties))
    with _shared.swept(docs.sparkSession):
        across = _across(nodes, blocks.where("region is not null").select("region").distinct(), found)
        more = _shared.written(across, "more", outside=True)
    if more.take(1):
        found = components(links(more).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    for done in (nodes, blocks, more):
        _shared.remove(done)
    return _classified(sketches.select("doc_id", "n_shingles", "digest"), firsts, found)


def _classified(rows: DataFrame, firsts: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc_id, n_shingles, digest) with their class, by way of the first row of each shingle set."""
    named = firsts.join(found.hint("merge"), "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component_id"))
    named = _shared.written(named, "classes")
    often = F.col("n") * HOT_SHARE > named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, others = F.broadcast(named.where(often).drop("n")), named.where(~often).drop("n")  # HOT_SHARE sets are hot at most
    linked = rows.where("digest is not null and doc_id is not null")
    linked = linked.join(hot, "digest").unionByName(
        linked.join(hot.select("digest"), "digest", "left_anti").join(others.hint("merge"), "digest")
    )
    # a row without a shingle is in the class of another text of its id, if it has one
    empty = rows.where("digest is null and doc_id is not null").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    empty = empty.withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
    nameless = rows.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    return reduce(DataFrame.unionByName, [linked, empty, nameless]).drop("digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    return classes(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _without_copies(docs: DataFrame, ids: DataFrame) -> DataFrame:
    removed = classes(ids).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(removed, "doc_id", "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class; rows that repeat an
    id and its text count once, different texts of one id count each for
    themselves, rows without an id all stay."""
    named = docs.where("doc_id is not null")
    if not named.groupBy("doc_id").count().where("count > 1").take(1):
        return _without_copies(docs, docs)
    digest = F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256)
    keys = (
        named.select("doc_id", digest.alias("_digest"))
        .distinct()
        .repartitionByRange("doc_id", "_digest")
        .sortWithinPartitions("doc_id", "_digest")
    )
    keys = _shared.written(keys.withColumn("_key", F.monotonically_increasing_id()), "keys")  # ordered like the ids
    keyed = (
        named.withColumn("_digest", digest)
        .join(keys, ["doc_id", "_digest"])
        .withColumnRenamed("doc_id", "_id")
        .withColumnRenamed("_key", "doc_id")
    )
    once = _without_copies(keyed, keyed).dropDuplicates(["doc_id"])
    return once.drop("doc_id").withColumnRenamed("_id", "doc_id").select(docs.columns).unionByName(docs.where("doc_id is null"))
