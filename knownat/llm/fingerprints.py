"""Document fingerprints as invertible Bloom lookup sketches, by DataFrame and SQL functions alone.

A text is cut into paragraphs (here: at line ends and at every sentence end, in any script) and each distinct paragraph becomes a 64-bit
digest. A sketch has three parts of cells; a digest falls into one cell of each part. A cell holds how many digests fell
into it, the exclusive or of them and that of their checks. Subtracting the sketches of two versions cell by cell leaves
only what differs; peeling takes the cells that hold one digest, removes those digests from their other cells, and so on.
Where peeling gets stuck, the two versions are sketched anew with twice the cells.

Cells are rows: sketches are sums and exclusive ors by cell, and a round of peeling is an explode and two such sums. So
the cost follows the number of paragraphs, however long a text is, and no array of cells is ever scanned.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.llm.store import stored

#: Cells in each part of the sketch that is kept as a text's fingerprint.
PART = 8
#: Least cells in each part of the sketches that are subtracted; more paragraphs have as many as both versions have.
LEAST_PART = 64
#: Rounds of peeling in one try, each over one part. Few digests are left after the fourth; where some are after the
#: last, the pair is sketched anew.
PEELS = 6
#: Tries, each with twice the cells of the one before.
TRIES = 20
#: Rows whose ids are broadcast at most, when their texts are read again.
FEW = 200_000
#: A long line has several paragraphs, as lines of whole documents would make edits look larger than they are.
PARAGRAPHS = r'(?<=[.!?؟۔][\"”»)]?)\\s+|(?<=[。！？])|\\n+'


def digests(text: str, pattern: str = PARAGRAPHS) -> Column:
    """The distinct digests of a text's paragraphs. Null and empty texts have none; spaces alone are no paragraph."""
    return F.expr(f"array_distinct(transform(filter(split(coalesce({text}, ''), '{pattern}'), p -> trim(p) <> ''), p -> xxhash64(p)))")


def _cells(digest: Column, part: Column) -> Column:
    """The cell of each part that a digest falls into."""
    return F.array(*[(F.pmod(F.xxhash64(digest, F.lit(t)), F.greatest(part, F.lit(1))) + t * part).cast("bigint") for t in range(3)])


def _check(digest: Column) -> Column:
    return F.hash(digest).cast("bigint")


def cells(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches as rows (keys, part, cell, n, k, c), from rows of keys, part, sign and an array of digests.

    Versions with the same keys are added up by their signs, so +1 and -1 subtract one sketch from the other. An array
    whose part is 0 is not sketched: its values travel along, each in the cell of its position.
    """
    single = versions.select(*keys, "part", "sign", F.posexplode("digests").alias("pos", "d"))
    into = F.when(F.col("part") == 0, F.array(F.col("pos").cast("bigint"))).otherwise(_cells(F.col("d"), F.col("part")))
    spread = single.select(*keys, "part", "sign", "d", F.explode(into).alias("cell"))
    return spread.groupBy(*keys, "part", "cell").agg(F.sum("sign").alias("n"), F.bit_xor("d").alias("k"), F.bit_xor(_check(F.col("d"))).alias("c"))


def peel(sketches: DataFrame, keys: list[str], only: Column | None = None, rounds: int = PEELS) -> DataFrame:
    """Peel subtracted sketches (`only` those rows, the others stay as they are): rows of recovered digests (cell null, n its
    sign, k the digest) and of cells that are left.

    A cell is pure if it holds one digest, by its count and check, and the digest belongs into the cell. Each round takes
    the pure cells of one part in turn, so that it meets no digest twice, and removes their digests from the other parts.
    Every grouping has the keys, so rows that are dealt out by keys stay there.
    """
    rows = sketches.where("n <> 0 or k <> 0").withColumn("kept", F.lit(None).cast("bigint"))
    own = _cells(F.col("k"), F.col("part"))
    none = F.lit(None).cast("bigint")

    def row(cell: Column, n: Column, k: Column, c: Column, kept: Column) -> Column:
        return F.struct(*[v.cast("bigint").alias(a) for v, a in ((cell, "cell"), (n, "n"), (k, "k"), (c, "c"), (kept, "kept"))])

    for turn in range(rounds):
        part = turn % 3
        pure = (F.lit(True) if only is None else only) & F.col("cell").isNotNull() & (F.abs("n") == 1) & (F.col("cell") == own[part]) & (F.col("c") == _check(F.col("k")))
        same = row(F.col("cell"), F.col("n"), F.col("k"), F.col("c"), F.col("kept"))
        found = row(none, F.col("n"), F.col("k"), F.lit(0), F.col("k"))
        taken = [row(own[t], -F.col("n"), F.col("k"), F.col("c"), none) for t in range(3) if t != part]
        opened = rows.select(*keys, "part", F.explode(F.when(F.coalesce(pure, F.lit(False)), F.array(found, *taken)).otherwise(F.array(same))).alias("x")).select(*keys, "part", "x.*")
        rows = opened.groupBy(*keys, "part", "cell", "kept").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
        rows = rows.where("kept is not null or n <> 0 or k <> 0")
    return rows


def _versions(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], part: dict[str, Column]) -> DataFrame:
    """For each kind of pair the left array with sign 1 and the right one with sign -1."""
    sides = [
        F.struct(F.lit(kind).alias("kind"), part[kind].cast("bigint").alias("part"), F.lit(sign).cast("bigint").alias("sign"), F.col(column).alias("digests"))
        for kind, columns in pairs.items()
        for sign, column in zip((1, -1), columns)
        if column
    ]
    return rows.select(*keys, F.explode(F.array(*sides)).alias("v")).select(*keys, "v.*")


def pair_part(left: str, right: str) -> Column:
    """Cells of each part for a pair: half as many again as both have digests, which the differences can't exceed."""
    return F.greatest(F.lit(LEAST_PART), (F.size(left) + F.size(right)) * 3 / 2).cast("bigint")


def differences(pairs: DataFrame, keys: list[str], left: str, right: str, larger: int = 1) -> DataFrame:
    """The digests that only the left or only the right array holds, recovered from sketches.

    One row for each key: the keys, only_left and only_right (arrays of digests). A null array counts as empty,
    repeated digests once. Keys must tell rows apart and not be null. A pair that can't be peeled is sketched again with
    twice the cells (the first time with `larger` times as many); after TRIES tries the job fails rather than guess.
    """
    empty = F.expr("cast(array() as array<bigint>)")
    work = pairs.select(*keys, *[F.array_distinct(F.coalesce(F.col(c), empty)).alias(n) for c, n in ((left, "_l"), (right, "_r"))])
    done = None
    for attempt in range(TRIES):
        part = {"pair": pair_part("_l", "_r") * larger * 2**attempt}
        peeled = peel(cells(_versions(work, keys, {"pair": ("_l", "_r")}, part), keys), keys)
        gathered = peeled.groupBy(*keys).agg(
            F.count(F.when(F.col("cell").isNotNull(), 1)).alias("_left_over"),
            *[F.collect_list(F.when(F.col("cell").isNull() & (F.col("n") == sign), F.col("k"))).alias(c) for sign, c in ((1, "only_left"), (-1, "only_right"))],
        )
        tried = work.join(gathered, keys, "left")
        tried = stored(tried.withColumns({"_left_over": F.coalesce("_left_over", F.lit(0)), **{c: F.coalesce(c, empty) for c in ("only_left", "only_right")}}), "peeled")
        good = tried.where("_left_over = 0").select(*keys, "only_left", "only_right")
        done = good if done is None else done.unionByName(good)
        work = tried.where("_left_over > 0").select(*keys, "_l", "_r")
        if work.isEmpty():
            return done
    raise ValueError(f"sketches could not be peeled in {TRIES} tries")


def likeness(left: Column, right: Column, apart: Column) -> Column:
    """Shared digests among all, from the sizes of two sets and how many digests only one of them holds: 1 for equal
    sets (two empty ones too), 0 where nothing is shared."""
    shared = (left + right - apart) / F.lit(2.0)
    return F.when(apart == 0, F.lit(1.0)).otherwise(shared / (shared + apart))


PLACE = ["_coarse", "_fine", "_row"]
#: Tasks that rows are dealt out to at most; beyond, each gets more rows and may spill.
MOST_TASKS = 100_000


def with_next(docs: DataFrame, key: str, columns: list[str], per_bucket: int = 500, cuts: int = 512, per_task: int = 1500) -> DataFrame:
    """Add `next_<column>`: the columns of the row with the next smaller key; after the last row, of the first.

    Keys are cut at up to `cuts` quantiles, and each range evenly into buckets of about `per_bucket` rows, or the root of all
    rows if that is more; a bucket is one window. To its end comes the first row of the next bucket that has rows, so rows
    travel once. The table of first rows has no more rows than that root and `cuts`, and is broadcast. Null keys come
    last, equal keys are ordered by the columns. A single row follows itself. The PLACE columns, which are added too, tell rows
    apart, and rows are dealt out by the first two, about `per_task` to a task.
    """
    keyed = docs.select(F.coalesce(F.col(key), F.lit(-(2**63))).cast("bigint").alias("_key"), F.col(key).isNull().alias("_null"), *docs.columns)
    found = keyed.agg(F.percentile_approx("_key", [i / cuts for i in range(1, cuts)], 100_000), F.count(F.lit(1))).first()
    bounds = sorted(set(found[0] or []))  # at most `cuts` numbers
    per_bucket = max(per_bucket, isqrt(found[1]))
    half = 1 << max(len(bounds), 1).bit_length()
    steps = F.array(*[F.lit(half >> i) for i in range(half.bit_length())])
    known = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    coarse = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.coalesce(F.get(known, at + s - 1) <= F.col("_key"), F.lit(False)), s).otherwise(0))
    cut = keyed.withColumn("_coarse", coarse)
    spans = cut.groupBy("_coarse").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.count(F.lit(1)).alias("_rows"))  # at most `cuts` rows
    pieces = F.ceil(F.col("_rows") / per_bucket)
    width = F.greatest(F.lit(1.0), (F.col("_high").cast("double") - F.col("_low") + 1) / pieces)
    fine = F.floor((F.col("_key").cast("double") - F.col("_low")) / width).cast("bigint")
    cut = cut.join(F.broadcast(spans), "_coarse").withColumn("_fine", fine).drop("_low", "_high", "_rows")
    order = [F.col("_key").desc(), F.col("_null"), *[F.col(c) for c in columns]]
    # the first row of each bucket goes to the end of the bucket before it as well
    heads = cut.groupBy("_coarse", "_fine").agg(F.max("_key").alias("_head"))
    within = Window.partitionBy("_coarse").orderBy("_fine")
    firsts = heads.groupBy("_coarse").agg(F.max("_fine").alias("_last_fine"))
    ring = Window.orderBy("_coarse")  # at most `cuts` rows
    above = firsts.select(
        F.col("_coarse").alias("_c"),
        F.coalesce(F.lead("_coarse").over(ring), F.first("_coarse").over(ring)).alias("_up_coarse"),
    )
    lowest = heads.groupBy(F.col("_coarse").alias("_up_coarse")).agg(F.min("_fine").alias("_up_fine"))
    above = above.join(lowest, "_up_coarse")
    targets = heads.withColumn("_up", F.lead("_fine").over(within)).join(F.broadcast(above), F.col("_coarse") == F.col("_c"))
    targets = targets.select(
        F.col("_head"), F.when(F.col("_up").isNotNull(), F.col("_coarse")).otherwise(F.col("_up_coarse")).alias("_coarse"), F.coalesce("_up", "_up_fine").alias("_fine"),
    )
    narrow = keyed.join(F.broadcast(targets), F.col("_key") == F.col("_head"))
    first = Window.partitionBy("_coarse", "_fine").orderBy(*order)
    guests = narrow.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*cut.columns, F.lit(True).alias("_guest"))
    both = cut.select("*", F.lit(False).alias("_guest")).unionByName(guests)
    both = both.repartition(min(max(found[1] // per_task, 1), MOST_TASKS), "_coarse", "_fine")
    along = Window.partitionBy("_coarse", "_fine").orderBy("_guest", *order)
    out = both.withColumns({f"next_{c}": F.lead(c).over(along) for c in columns} | {"_row": F.row_number().over(along)}).where(~F.col("_guest"))
    return out.select(*PLACE, *docs.columns, *[f"next_{c}" for c in columns])


def _edited(placed: DataFrame) -> DataFrame:
    """Add `edited`: the last third of the text's code points gives way to the first as many of the next text."""
    length = F.char_length("text")
    third = F.floor(length / 3).cast("int")
    return placed.withColumn("edited", F.concat(F.substring("text", F.lit(1), length - third), F.substring("next_text", F.lit(1), third)))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and the likeness to the edited and to the next text.

    The fingerprint columns are sketches of 3 x PART cells for any length of text. The likeness is not taken from them but
    from separate sketches of both versions, sized by their digests; fingerprints alone don't give back more differences
    than their few cells hold.
    The edit replaces the last third of the code points by the first as many of the next document in descending doc_id.
    A null text is empty; equal texts have equal fingerprints; texts without a paragraph are alike (1). Repeated
    rows each get a row. Other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", digests("text"))
    edited = _edited(with_next(texts, "doc_id", ["doc_id", "text", "own"]))
    length = F.char_length("text")
    pairs = {"edited": ("own", "new"), "next": ("own", "next_own"), "own": ("own", ""), "new": ("new", "")}
    part = {"edited": pair_part("own", "new"), "next": pair_part("own", "next_own"), "own": F.lit(PART), "new": F.lit(PART)}
    # everything travels as rows, so that the texts are dealt out once and no join follows
    quarters = [F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(4)]
    arrays = edited.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).select(
        *PLACE, "own", digests("edited").alias("new"), "next_own",
        F.array(F.col("doc_id").cast("bigint"), F.col("next_doc_id").cast("bigint"), length.cast("bigint"), F.size("own").cast("bigint"), F.size("next_own").cast("bigint"), *quarters).alias("facts"),
    )
    arrays = arrays.withColumn("facts", F.concat("facts", F.array(F.size("new").cast("bigint"))))
    pairs = {"edited": ("own", "new"), "next": ("own", "next_own"), "own": ("own", ""), "new": ("new", ""), "facts": ("facts", "")}
    part = {"edited": pair_part("own", "new"), "next": pair_part("own", "next_own"), "own": F.lit(PART), "new": F.lit(PART), "facts": F.lit(0)}
    keys = [*PLACE, "kind"]
    peeled = peel(cells(_versions(arrays, PLACE, pairs, part), keys), keys, F.col("kind").isin("edited", "next"))
    kind, cell = F.col("kind"), F.col("cell")
    rows = peeled.groupBy(*PLACE).agg(
        *[F.max(F.when((kind == "facts") & (cell == i), F.col("k"))).alias(f"f{i}") for i in range(10)],
        F.count(F.when(kind.isin("edited", "next") & cell.isNotNull(), 1)).alias("left_over"),
        *[F.count(F.when((kind == k) & cell.isNull(), 1)).alias(f"apart_{k}") for k in ("edited", "next")],
        *[F.array_sort(F.collect_list(F.when(kind == k, F.struct("cell", "n", "k")))).alias(f"cells_{k}") for k in ("own", "new")],
    )
    written = {k: F.expr(f"array_join(transform(cells_{k}, c -> concat_ws('.', c.cell, c.n, lower(hex(c.k)))), ' ')") for k in ("own", "new")}
    sha = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"f{i}"))), 16, "0") for i in range(5, 9)])
    rows = rows.select(
        F.col("f0").alias("doc_id"), F.col("f1").alias("next_doc_id"), F.col("f2").alias("n_chars"), sha.alias("edited_sha256"),
        written["own"].alias("fingerprint"), written["new"].alias("edited_fingerprint"),
        likeness(F.col("f3"), F.col("f9"), F.col("apart_edited")).alias("near_edited"), likeness(F.col("f3"), F.col("f4"), F.col("apart_next")).alias("near_next"), "left_over",
    )
    rows = stored(rows, "versions")
    near = ["near_edited", "near_next"]
    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near]
    return rows.where("left_over = 0").select(*result).unionByName(_again(texts, rows.where("left_over > 0"), near).select(*result))


def _again(texts: DataFrame, stuck: DataFrame, near: list[str]) -> DataFrame:
    """Likeness of the rows whose sketches got stuck, a few in a thousand, from larger sketches of their texts.

    Only those texts and the ones after them are read; with them go all rows of the same keys, so each row meets the
    same next text as before.
    """
    place = F.lit(-(2**63))
    wanted = stuck.select(F.coalesce("doc_id", place).alias("_id")).union(stuck.select(F.coalesce("next_doc_id", place))).distinct()
    if stuck.count() <= FEW:  # then the ids take a few MB
        wanted = F.broadcast(wanted)
    few = texts.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), place)).join(wanted, "_id", "left_semi").drop("_id")
    edited = _edited(with_next(few, "doc_id", ["doc_id", "text", "own"]))
    arrays = edited.select("doc_id", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", digests("edited").alias("new"), "next_own").dropDuplicates(["doc_id", "edited_sha256"])
    ids = [F.coalesce(F.col("doc_id").cast("bigint"), place).alias("_id"), "edited_sha256"]
    arrays = stored(arrays.select(*ids, "own", "new", "next_own").join(stuck.select(*ids).distinct(), ["_id", "edited_sha256"], "left_semi"), "stuck")
    found = None
    for name, right in zip(near, ("new", "next_own")):
        apart = differences(arrays, ["_id", "edited_sha256"], "own", right, larger=2)
        apart = apart.join(arrays, ["_id", "edited_sha256"]).select("_id", "edited_sha256", likeness(F.size("own"), F.size(right), F.size("only_left") + F.size("only_right")).alias(name))
        found = apart if found is None else found.join(apart, ["_id", "edited_sha256"])
    return stuck.drop(*near).withColumn("_id", F.coalesce("doc_id", place)).join(found, ["_id", "edited_sha256"])
