"""Near copies of texts: SimHashes of five-word shingles find candidates, the exact similarity of their shingles decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passel.llm.components import connected_components, widened
from passel.llm.simhash import _LOWER, _shingle_hashes
from passel.llm.tables import ROW, delete, held, of_row, released, stored, tidy

SHINGLE_WORDS = 5
# The least Jaccard similarity of two sets of shingles that links them, as a fraction.
LEAST = (4, 5)
# Bits of the short SimHashes, each met in the middle at a distance of 2 bits, of a corpus of up to 5 million texts.
LEAST_KEY_BITS = 24
# The share of bits that differ at a similarity of 0.8, and the share of such pairs that may meet in no table.
BITS_APART = 0.1515
MISSED = 0.042
# Unrelated texts that a bucket may hold on average before keys get longer.
STRANGERS = 8
# Another 64 bits screen those that meet; near copies differ in more of them once in ten thousand pairs.
CHECK_BITS = 22
# Texts of a bucket, in the order of their size, that a text is compared with at first.
BACK = 8
# Texts of a crowded bucket that a task compares with as many others at once, and rows of that comparison.
BLOCK = 1024
STEP = 256


def key_shape(n_texts: int) -> tuple[int, int]:
    """How many short SimHashes a corpus of ``n_texts`` has, and their bits.

    Unrelated texts fill a bucket with (bits + 1) * n / 2^bits texts, so keys grow with the logarithm of the corpus.
    Longer keys meet more rarely (24 bits in 0.27 of the pairs at a similarity of 0.8), which more tables make up for:
    in any shape such a pair meets somewhere with a probability of at least 0.958, at 0.85 with 0.99.
    """
    bits = LEAST_KEY_BITS
    while (bits + 1) * n_texts > STRANGERS << bits:
        bits += 2
    meets = sum(math.comb(bits, d) * BITS_APART**d * (1 - BITS_APART) ** (bits - d) for d in range(3))
    return math.ceil(math.log(MISSED) / math.log(1 - meets)), bits


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the runs of five words, cut and folded as those of a fingerprint."""
    blocks = [*_shingle_hashes(text.encode().translate(_LOWER), SHINGLE_WORDS)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, "<u8")


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other 64 bits of the same hashes (the finaliser of SplitMix64)."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (number + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, tables: int, bits: int) -> tuple[list[int], int]:
    """The short SimHashes of a set of shingles and the bits for the screening, as a signed number."""
    words = -(-tables * bits // 64) + 1
    counts = np.zeros((words, 64), np.int64)
    for number in range(words):
        for start in range(0, len(hashes), 1 << 15):
            mixed = _mixed(hashes[start : start + (1 << 15)], number)
            ones = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # Sums of 255 bits fit a byte.
            for low in range(0, len(ones), 255):
                counts[number] += ones[low : low + 255].sum(axis=0, dtype=np.uint8)
    over = (2 * counts > len(hashes)).ravel()
    keys = over[: tables * bits].reshape(tables, bits) @ (1 << np.arange(bits))
    return keys.tolist(), int(np.packbits(over[-64:], bitorder="little").view("<i8")[0])


SKETCH = "struct<class:long,n:int,check:long,keys:array<long>>"
SKETCH_TYPE = pa.struct([("class", pa.int64()), ("n", pa.int32()), ("check", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _sketcher(tables: int, bits: int):
    @F.arrow_udf(SKETCH)
    @tidy
    def sketched(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            own = shingles(text.as_py() or "")
            keys, check = sketch(own, tables, bits)
            name = int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))
            rows.append({"class": name, "n": len(own), "check": check, "keys": keys})
        return pa.array(rows, SKETCH_TYPE)

    return sketched


def _shingler():
    @F.arrow_udf("array<long>")
    @tidy
    def shingled(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py() or "").view(np.int64) for t in texts], pa.list_(pa.int64()))

    return shingled


def candidates(classes: DataFrame, bits: int, back: int = BACK) -> DataFrame:
    """Pairs (u, v) of classes that meet within two bits of a short SimHash and may be similar enough by their sizes
    and the other bits; ``back`` is how many texts of a bucket lie between them at least.

    A bucket is ordered by size and each text meets the ``back`` before it, so no bucket gives the square of its texts.
    The members u of a larger bucket are rows without v that name the ``variant``; ``crowded_pairs`` compares them.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(bits))]])
    variants = F.transform(
        "keys", lambda key, table: F.transform(masks, lambda m: table.cast("long") * (1 << bits) + key.bitwiseXOR(m))
    )
    emitted = classes.where("n > 0").select("class", "n", "check", F.explode(F.flatten(variants)).alias("variant"))
    ordered = Window.partitionBy("variant").orderBy("n", "class")
    others = F.collect_list(F.struct("class", "n", "check")).over(ordered.rowsBetween(-back - 1, -1))
    met = emitted.select("class", "n", "check", "variant", others.alias("others"), F.row_number().over(ordered).alias("place"))
    met = met.where("place > 1")
    placed = F.transform("others", lambda o, i: F.struct(o["class"].alias("v"), o["n"].alias("m"), o["check"].alias("c"), (F.size("others") - i).alias("back")))
    near = F.filter(
        placed,
        lambda o: (o["back"] <= back)
        & (o["m"] * LEAST[1] >= F.col("n") * LEAST[0])
        & (F.bit_count(o["c"].bitwiseXOR(F.col("check"))) <= CHECK_BITS),
    )
    none, nowhere = (F.lit(None).cast("long").alias(name) for name in ("v", "variant"))
    member = F.struct("class", none, F.lit(0).alias("back"), "variant")
    # The first text that does not meet all before it also names those.
    before = F.transform("others", lambda o: F.struct(o["class"], none, F.lit(0).alias("back"), F.col("variant")))
    members = (
        F.when(F.col("place") == back + 2, F.concat(F.array(member), before))
        .when(F.col("place") > back + 2, F.array(member))
        .otherwise(F.array().cast("array<struct<class:long,v:long,back:int,variant:long>>"))
    )
    pairs = F.transform(near, lambda o: F.struct(F.col("class"), o["v"].alias("v"), o["back"].alias("back"), nowhere))
    rows = met.select(F.explode(F.concat(pairs, members)).alias("o")).select(F.col("o.class").alias("u"), "o.v", "o.back", "o.variant")
    return rows.groupBy("u", "v", "variant").agg(F.min("back").alias("back"))


def _between_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """The pairs of different components between two blocks of a bucket, or within one."""
    rows = rows.sort_by("n")
    name, n, check, component, block = (rows.column(c).to_numpy() for c in ("class", "n", "check", "component", "block"))
    check, one = check.view(np.uint64), key[1].as_py() == key[2].as_py()
    found = []
    for start in range(0, len(n), STEP):
        end = min(start + STEP, len(n))
        low = int(np.searchsorted(n, -(-int(n[start]) * LEAST[0] // LEAST[1])))
        a, b = np.arange(start, end)[:, None], np.arange(low, end)
        near = np.bitwise_count(check[a] ^ check[b]) <= CHECK_BITS
        near &= (n[b] * LEAST[1] >= n[a] * LEAST[0]) & (component[b] != component[a])
        near &= ((block[b] == block[a]) == one) & (b < a)
        u, v = np.nonzero(near)
        found.append(np.stack([name[start:end][u], name[low:end][v]]))
    u, v = np.concatenate(found, axis=1)
    return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})


def crowded_pairs(members: DataFrame, classes: DataFrame, linked: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pairs (u, v) that meet in the buckets of ``members`` (variant, class), whose texts are not ``linked``
    and may be similar enough by their sizes and the other bits.

    Buckets of one component are left out. A large bucket is cut in blocks by a hash, and any two blocks meet in a
    task of their own: no task has more than about two blocks of rows, however large the bucket.
    """
    component = linked.select(F.col("node").alias("class"), "component")
    named = members.join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    crowded = named.groupBy("variant").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    crowded = crowded.where("low < high").select("variant", "blocks")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block")
    placed = named.join(crowded, "variant").join(classes.select("class", "n", "check"), "class")
    placed = placed.select("variant", "class", "n", "check", "component", own, "blocks")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    return dealt.groupBy("variant", "i", "j").applyInArrow(_between_blocks, "u long, v long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""
    one, two = (sets.select(F.col("class").alias(c), F.col("own").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    shared = pairs.select("u", "v").join(one, "u").join(two, "v")
    shared = shared.select("u", "v", (F.size("a") + F.size("b")).alias("both"), F.size(F.array_intersect("a", "b")).alias("common"))
    return shared.where(F.col("common") * LEAST[1] >= (F.col("both") - F.col("common")) * LEAST[0]).select("u", "v")


def _set_finder(texts: DataFrame, classes: DataFrame):
    """A function that stores the sets of shingles of named classes, read from one text of each, and says where."""

    def sets_of(named: DataFrame) -> tuple[DataFrame, str]:
        chosen = classes.join(named, "class").select("class", "first.*")
        return stored(texts.join(chosen, ["doc_id", "version"]).select("class", _shingler()("text").alias("own")).dropDuplicates(["class"]))

    return sets_of


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()


def near_text_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_texts: int | None = None, back: int = BACK, block: int = BLOCK
) -> DataFrame:
    """For each row ``doc_id``, ``version`` (a hash of its text) and ``component_id``, the smallest id that links of
    a shingle similarity of at least 0.8 lead to.

    Texts of equal sets of shingles are one class and always linked; texts without words are one class. Rows without
    an id take part in nothing and have a null component. Candidates next to each other in a bucket are compared
    first, then those up to ``back`` places apart, at last all others of the bucket, each time only where they are not
    yet in one component; ``back`` and ``block`` change the work, not the result. ``n_texts`` sets the length of the
    keys; by default the rows are counted.
    """
    tables, bits = key_shape(docs.count() if n_texts is None else n_texts)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    rows, _ = stored(texts.select("doc_id", "version", _sketcher(tables, bits)("text").alias("s")).select("doc_id", "version", "s.*"))
    classes, _ = stored(
        rows.where("doc_id is not null").groupBy("class").agg(
            F.min(F.struct("doc_id", "version")).alias("first"), F.first("n").alias("n"), F.first("check").alias("check"), F.first("keys").alias("keys")
        )
    )
    met, *folders = stored(candidates(classes, bits, back))
    pairs, members = met.where("v is not null"), met.where("v is null").select("variant", F.col("u").alias("class"))
    sets_of = _set_finder(texts, classes)
    asked = _ends(pairs)
    sets, folder = sets_of(asked)
    folders.append(folder)
    linked = connected_components(_confirmed(pairs.where("back = 1"), sets))
    rest = pairs.where("back > 1")
    for end in ("u", "v"):
        rest = rest.join(linked.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    links, folder = stored(_confirmed(rest.where("coalesce(u_in, u) <> coalesce(v_in, v)"), sets))
    folders.append(folder)
    if not links.isEmpty():
        linked = widened(linked, links)
    if not members.isEmpty():
        more, folder = stored(crowded_pairs(members, classes, linked, block))
        folders.append(folder)
        if not more.isEmpty():
            others, folder = sets_of(_ends(more).join(asked, "class", "left_anti"))
            folders.append(folder)
            linked = widened(linked, _confirmed(more, sets.unionByName(others)))
    for folder in folders:
        delete(docs.sparkSession, folder)
    named = classes.select("class", F.col("first.doc_id").alias("first")).join(linked, F.col("class") == F.col("node"), "left")
    named = named.select("class", "first", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = named.join(least, "component").select("class", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return rows.join(labelled, "class", "left").select("doc_id", "version", own)


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group, and those without an id."""
    groups = near_text_groups(docs, id_col, text_col)
    first = groups.where("doc_id = component_id").select("doc_id", "version").distinct()
    text = F.coalesce(of_row(text_col), F.lit(""))
    rows = held(docs).select(ROW, of_row(id_col).alias("doc_id"), F.xxhash64(text).alias("version"))
    kept = rows.join(first.withColumn("kept", F.lit(True)), ["doc_id", "version"], "left").where("kept or doc_id is null")
    return released(kept, docs.columns)
