"""Line dedup by a deletion-neighbourhood join, edit bounds of one to three.

Lines within the bound agree on one of a few stretches, so hashes of these first bring lines together.
Then a line is halved again and again: a half that must be equal goes into the key, and the bound is
shared out among what stays open, until that is short. Of a short stretch every variant is a hashed
key: some characters deleted, the places marked where the other line may have one more. Lines with an
equal variant are within the bound of each other, so no pairs are made: each only needs the earliest
line of its key. That one is verified by the edit distance of the whole lines. Keys of few lines need
no more variants: their open stretches are compared, each with those of the earlier lines. Most pairs
are told apart by their lengths and by which characters stand in them an odd number of times; of the
others only what lies between their first and last difference is measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logmere.llm.common import BROADCAST_ROWS, NOT_SPACE, checked, stored, unused

LEAST_CHARS = 30
MAX_EDITS = 2
MOST_CORE = 16
GRAIN = 8
FEW = 1_000
FEW_CHARS = 16_000_000
BLOCK = 16
LAST = (1 << 63) - 1

HASH = [("h1", 0), ("h2", 1)]


def _hashes(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(F.lit(salt), text).alias(name) for name, salt in HASH]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """``(doc, at, line)``: lines of ``least`` characters, with a word, and their places."""
    pieces = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return pieces.filter((F.length("line") >= least) & F.col("line").rlike(NOT_SPACE))


def _segments(line: Column, edits: int) -> Column:
    """Hashes of stretches of a line, so that lines within ``edits`` share one.

    A line is cut in ``edits`` + 1 stretches, of which one stays whole. It is then found in the
    other line, shifted by at most as many places as there are stretches on its nearer side.
    """
    size = F.length(line)
    raw = [F.floor((size + longer) / (edits + 1)).cast("int") for longer in (0, edits)]
    least, most = (F.when(part < 8, part).otherwise(part - part % 4) for part in raw)

    def hashes(part: Column) -> Column:
        found = []
        for number in range(edits + 1):
            from_left = number <= edits - number
            before = number if from_left else edits - number
            for shift in range(-before, before + 1):
                start = part * before + shift
                text = (
                    F.substring(line, start + 1, part)
                    if from_left
                    else F.substring(line, size - start - part + 1, part)
                )
                found.append(F.xxhash64(F.lit(number), part, text))
        return F.array(*found)

    # The longer line's length decides how long the stretches are: one of two values at most.
    return F.when(least == most, hashes(least)).otherwise(F.concat(hashes(least), hashes(most)))


def _odd_characters(line: Column) -> Column:
    """64 bits: which of as many classes of characters stand an odd number of times in a line.

    One edit flips two bits at most. Characters from U+0080 on have the classes of their hashes.
    """
    code = lambda c: F.when(F.octet_length(c) > 1, F.xxhash64(c)).otherwise(F.ascii(c))
    return F.aggregate(
        F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code(c), F.lit(64)).cast("int")))
    )


def _let(values: list[Column], use) -> Column:
    """``use`` of values that are worked out once."""
    names = [f"v{k}" for k in range(len(values))]
    given = F.array(F.struct(*(v.alias(n) for v, n in zip(values, names))))
    return F.get(F.transform(given, lambda x: use(*(x[n] for n in names))), F.lit(0))


def _within(x: Column, y: Column, bound: Column | int, edits: int) -> Column:
    """Whether two texts are within ``bound`` (``edits`` at most) of each other.

    Blocks that are equal at both starts or both ends are taken off before, as this changes no distance.
    """

    def widths(size):
        powers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(size / BLOCK + 1)).cast("int")))
        return F.transform(F.reverse(powers), lambda k: F.call_function("shiftleft", F.lit(BLOCK), k))

    def start(x, y):
        more = lambda at, w: F.when(F.substring(x, at + 1, w) == F.substring(y, at + 1, w), at + w).otherwise(at)
        at = F.aggregate(widths(F.length(x)), F.lit(0), more)
        return _let([at], lambda at: _let([F.substring(x, at + 1, F.length(x)), F.substring(y, at + 1, F.length(y))], end))

    def end(x, y):
        def at_end(m, n):
            def more(at, w):
                fits = at + w <= F.least(m, n)
                same = F.substring(x, m - at - w + 1, w) == F.substring(y, n - at - w + 1, w)
                return F.when(fits & same, at + w).otherwise(at)

            return _let([m, n, F.aggregate(widths(F.least(m, n)), F.lit(0), more)], rest)

        def rest(m, n, at):
            return F.levenshtein(F.substring(x, F.lit(1), m - at), F.substring(y, F.lit(1), n - at), edits)

        return _let([F.length(x), F.length(y)], at_end)

    return (x == y) | start(x, y).between(0, bound)


def _stack(edits: int) -> list[str]:
    """Columns of the stretches that are still open, the next one first, and how many edits each may have."""
    return [f"{name}{k}" for k in range(edits) for name in ("core", "bound")]


def _shared(rows: DataFrame, edits: int) -> DataFrame:
    """Rows whose key another line has as well, with other text in every open stretch and at both ``differs``; ``few`` says whether they can be compared.

    Lines with equal text in one of them are found where that one is closed.
    """
    cores = [c for c in _stack(edits) if c.startswith("core")]
    ends = [f(v).alias(f"{n}{k}") for k, v in enumerate([F.col("h1"), *(F.xxhash64(c) for c in cores), F.col("differs0"), F.col("differs1")])
            for n, f in (("low", F.min), ("high", F.max))]
    used = [F.col(c).isNotNull().alias(f"used{k}") for k, c in enumerate(cores)]
    tests = F.col("low0") < F.col("high0")
    used += [F.col(f"differs{k}").isNotNull().alias(f"used{edits + k}") for k in range(2)]
    for k in range(edits + 2):
        tests &= ~F.col(f"used{k}") | (F.col(f"low{k + 1}") < F.col(f"high{k + 1}"))
    chars = F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in cores))
    few = (F.count(F.lit(1)) <= FEW) & (chars <= FEW_CHARS)
    keys = rows.groupBy("key", *used).agg(*ends, few.alias("few")).filter(tests)
    keys = checked(stored(keys.select("key", "few"), "line-keys"))
    return rows.join(keys, "key").drop("differs0", "differs1")


def _late_of_few(rows: DataFrame, edits: int) -> DataFrame:
    """``(h1, h2)`` of lines with an earlier one in reach, for keys with few rows.

    Two lines are in reach if each open stretch is, within its own share of the edits: the others are spent.
    """
    cores = [c for c in _stack(edits) if c.startswith("core")]
    bounds = [c for c in _stack(edits) if c.startswith("bound")]
    row = F.struct(
        "first", "at", "h1", "h2", "size", "odd",
        *(F.coalesce(c, F.lit("")).alias(c) for c in cores),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in bounds),
    )
    groups = rows.groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("given"))

    def in_reach(x: Column, y: Column) -> Column:
        near = F.bit_count(x["odd"].bitwiseXOR(y["odd"])) <= 2 * edits
        near &= F.abs(x["size"] - y["size"]) <= edits
        near &= (x["h1"] != y["h1"]) | (x["h2"] != y["h2"])
        for core, bound in zip(cores, bounds):
            near &= _within(x[core], y[core], x[bound], edits)
        return near

    def late(x: Column, k: Column) -> Column:
        return F.exists(F.slice("given", F.lit(1), k), lambda y: in_reach(x, y))

    return groups.select(F.explode(F.filter("given", late)).alias("x")).select("x.h1", "x.h2")


def _half(size: Column) -> Column:
    """About half of a size, so that sizes that differ by little seldom have another half."""
    parts = [(F.floor(size / (2 * grain)) * grain).cast("int") for grain in (GRAIN, GRAIN // 2, GRAIN // 4)]
    return F.when(size > 4 * GRAIN, parts[0]).when(size > 2 * GRAIN, parts[1]).otherwise(parts[2])


def _next_step(bound: int) -> Column:
    """What may become of the next open stretch, with ``bound`` edits: an array of structs.

    A short one closes up to its first edit, a place where a character may stand or not. A long one is
    parted by the length of the longer of two lines: its start closes, or its end, or it is cut in two
    with a share of the edits each. One of a length at the limit does both, as its partner may be longer.
    ``differs0`` and ``differs1`` are digests of what is equal in two lines that another step finds.
    """
    core, size = F.col("core0"), F.length("core0")
    none = F.lit(None).cast("string")

    def step(tag, closed, left, more, after=none, last=0, differs=()):
        return F.struct(
            F.xxhash64("key", F.lit(tag), *closed).alias("key"),
            left.alias("core"),
            F.lit(more).alias("bound"),
            after.alias("after"),
            F.lit(last).alias("last"),
            *(
                (differs[k] if k < len(differs) else F.lit(None)).cast("long").alias(f"differs{k}")
                for k in range(2)
            ),
        )

    def upto(k):
        return F.substring(core, F.lit(1), k)

    def beyond(k):
        return F.substring(core, k + 1, size)

    def edits(k):
        # The first edit is where two lines first differ. Nothing else may, or more edits come behind it.
        here = F.xxhash64(F.substring(core, k + 1, F.lit(1)))
        found = []
        for gone in range(2):
            found.append(step("whole", [upto(k), beyond(k + gone)], none, 0, differs=[here]))
            if bound > 1:
                found.append(step("edit", [upto(k)], beyond(k + gone), bound - 1, differs=[here]))
        return F.array(*found)

    edited = F.flatten(F.transform(F.sequence(F.lit(0), size), edits))
    halves = []
    for longer in range(bound + 1):
        part = _half(size + longer)
        start, end = F.xxhash64(upto(part)), F.xxhash64(beyond(size - part))
        halves.append(step("start", [upto(part)], beyond(part), bound))
        halves.append(step("end", [beyond(size - part)], upto(size - part), bound, differs=[start]))
        for first in range(1, bound):
            for k in range(-first, first + 1):
                cut = part + k
                halves.append(
                    step(f"both{first}", [], upto(cut), first, beyond(cut), bound - first, differs=[start, end])
                )
    nothing = F.array().cast("array<struct<key:bigint,core:string,bound:int,after:string,last:int,differs0:bigint,differs1:bigint>>")
    return F.concat(
        F.when(size <= MOST_CORE, edited).otherwise(nothing),
        F.when(size > MOST_CORE - bound, F.array_distinct(F.array(*halves))).otherwise(nothing),
    )


def _stepped(rows: DataFrame, edits: int) -> DataFrame:
    """One more step for the next open stretch of each row."""
    steps = F.when(F.col("bound0") == 1, _next_step(1))
    for bound in range(2, edits + 1):
        steps = steps.when(F.col("bound0") == bound, _next_step(bound))
    rows = rows.withColumn("step", F.explode(steps))
    closed, opened = F.col("step.core").isNull(), F.col("step.after").isNotNull()
    old = lambda name, k: F.col(f"{name}{k}") if k < edits else F.lit(None)
    left = []
    for k in range(edits):
        for name, top, after in (("core", "step.core", "step.after"), ("bound", "step.bound", "step.last")):
            kept = F.col(top) if k == 0 else old(name, k)
            pushed = F.col(top) if k == 0 else F.col(after) if k == 1 else old(name, k - 1)
            left.append(
                F.when(closed, old(name, k + 1)).when(opened, pushed).otherwise(kept).alias(f"{name}{k}")
            )
    return rows.select("h1", "h2", "first", "at", "size", "odd", F.col("step.key").alias("key"), "step.differs0", "step.differs1", *left)


def _earliest(found: DataFrame) -> DataFrame:
    """For each line the earliest one that it shares a key with, if that isn't itself.

    Lines with a key in common are all within the bound of each other: both fit one text in which a
    character may stand or not at as many places as there may be edits.
    """
    found = found.select(F.struct("first", "at", "h1", "h2").alias("line"), "key")
    by_key = stored(
        found.groupBy("key")
        .agg(F.min("line").alias("partner"), F.max("line").alias("latest"))
        .filter(F.col("partner") < F.col("latest"))
        .select("key", "partner"),
        "line-earliest",
    )
    near = found.join(by_key, "key").filter(F.col("partner") < F.col("line"))
    return near.groupBy("line").agg(F.min("partner").alias("partner"))


def near_lines(docs: DataFrame, lines: DataFrame, least: int, edits: int) -> DataFrame:
    """``(h1, h2)`` of the lines that have an earlier line within ``edits``.

    ``lines``: one row for each different line with ``h1, h2, first`` and the array ``keys``.
    """
    keyed = lines.select("h1", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    keys = checked(stored(shared.filter("low < high").select("key"), "line-keys"))
    wanted = stored(
        lines.select("h1", "h2", "first", F.explode("keys").alias("key")).join(keys, "key", "left_semi"),
        "line-candidates",
    )
    texts = _lines(docs, least).select("doc", "at", "line", *_hashes(F.col("line")))
    texts = (
        texts.join(checked(stored(wanted.select("h1", "h2", "first").distinct(), "line-wanted")), ["h1", "h2"])
        .filter(F.col("doc") == F.col("first"))
        .groupBy("h1", "h2", "first", "line")
        .agg(F.min("at").alias("at"))
    )
    texts = texts.withColumns({"size": F.length("line"), "odd": _odd_characters(F.col("line"))})
    texts = stored(texts, "line-texts")
    empty = [F.lit(None).cast("string" if c.startswith("core") else "int").alias(c) for c in _stack(edits)[2:]]
    none = F.lit(None).cast("long")
    rows = texts.join(wanted.select("h1", "h2", "key"), ["h1", "h2"]).select(
        "h1", "h2", "first", "at", "size", "odd", "key", none.alias("differs0"), none.alias("differs1"),
        F.col("line").alias("core0"), F.lit(edits).alias("bound0"), *empty,
    )
    rows = stored(rows, "line-steps")
    late = found = None
    while True:
        rows = stored(_shared(rows, edits), "line-open")
        few = _late_of_few(rows.filter("few"), edits)
        late = few if late is None else late.unionByName(few)
        rows = rows.filter("not few").drop("few")
        if not rows.head(1):
            break
        rows = stored(_stepped(rows, edits), "line-steps")
        whole = rows.filter("core0 is null").select("h1", "h2", "first", "at", "key")
        found = whole if found is None else found.unionByName(whole)
        rows = rows.filter(F.col("core0").isNotNull())
    if found is None:
        return late.distinct()
    pairs = _earliest(found).select(
        F.col("line.h1").alias("h1"),
        F.col("line.h2").alias("h2"),
        F.col("partner.h1").alias("p1"),
        F.col("partner.h2").alias("p2"),
    )
    mine = texts.select("h1", "h2", "line")
    other = texts.select(
        F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("earlier")
    )
    verified = (
        pairs.join(mine, ["h1", "h2"])
        .join(other, ["p1", "p2"])
        .filter(_within(F.col("line"), F.col("earlier"), edits, edits))
    )
    return late.unionByName(verified.select("h1", "h2")).distinct()


def _rebuilt(text: Column, gone: Column, least: int) -> Column:
    """``text`` without the lines of ``least`` characters whose hash is in ``gone`` and without later copies in it.

    A struct of the text and how many lines it has left.
    """

    def left(lines: Column) -> Column:
        marked = F.transform(
            lines,
            lambda x, k: F.struct(
                F.when(
                    (F.length(x) >= least) & x.rlike(NOT_SPACE), F.xxhash64(F.lit(0), x)
                ).alias("h"),
                k.alias("at"),
            ),
        )
        marks = F.transform(gone, lambda h: F.struct(h.alias("h"), F.lit(-1).alias("at")))
        return _kept(F.array_sort(F.concat(marked, marks)), lines)

    def _kept(given: Column, lines: Column) -> Column:
        def leading(ordered: Column) -> Column:
            def leads(k: Column) -> Column:
                here = F.get(ordered, k)
                before = F.get(ordered, k - 1)["h"]
                return (here["at"] >= 0) & (
                    here["h"].isNull() | F.coalesce(before != here["h"], F.lit(True))
                )

            places = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), leads)
            at = F.array_sort(F.transform(places, lambda k: F.get(ordered, k)["at"]))
            return F.struct(
                F.array_join(F.transform(at, lambda k: F.get(lines, k)), "\n").alias("text"),
                F.size(at).alias("lines"),
            )

        return F.get(F.transform(F.array(given), leading), F.lit(0))

    return F.get(F.transform(F.array(F.split(text, "\n")), left), F.lit(0))


def dedup_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    max_edits: int = MAX_EDITS,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_equal: int | None = None,
) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts, and ``lines_gone``.

    A line (up to ``\\n``, with a word) goes if an equal line comes earlier: in a document with a
    smaller id, or higher up in the same one. It takes ``least_equal`` characters, or ``least_chars``
    if that isn't given. Lines of ``least_chars`` characters go as well if another such line within
    ``max_edits`` (0 to 3) characters deleted, added or changed comes earlier. Shorter lines stay. Each row is a document of its own: null ids
    come last, and rows with equal ids, or none, follow one another by a digest of the text; of rows
    equal in both any one comes first. Null texts stay null, empty ones empty. A text may become empty.
    Documents never go, and other columns stay as they are, but for one named ``lines_gone``, which is
    replaced. An empty table gives no rows.
    """
    if max_edits not in range(4):
        raise ValueError("max_edits is 0 to 3")
    least_equal = least_chars if least_equal is None else min(least_equal, least_chars)
    columns = [c for c in docs.columns if c != "lines_gone"]
    mark = unused(docs.columns)
    key, gone_name, lines_name, left_name = (f"{mark}{c}" for c in ("key", "gone", "lines", "left"))
    order = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id")
    # Written, so that a row's number stays the same however often the rows are read.
    docs = docs.select(*columns, F.monotonically_increasing_id().alias(f"{mark}number"))
    docs = stored(docs, "line-documents")
    row = F.struct(
        order, F.xxhash64(F.col(text_column)).alias("text"), F.col(f"{mark}number").alias("number")
    )
    given = docs.select(row.alias("doc"), F.col(text_column).alias("text"))
    line = F.col("line")
    size = F.length(line)
    keys = F.when(size >= least_chars, _segments(line, max_edits)) if max_edits else F.lit(None)
    lines = (
        _lines(given, least_equal)
        .select("doc", *_hashes(line), keys.cast("array<bigint>").alias("keys"))
        .groupBy("h1", "h2", "keys")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    )
    lines = stored(lines, "lines")
    repeated = lines.filter("first < last").select("h1", "h2", "first", F.lit(False).alias("late"))
    if max_edits:
        late = near_lines(given, lines.filter(F.col("keys").isNotNull()), least_chars, max_edits)
        kind = lines.schema["first"].dataType
        late = late.select("h1", "h2", F.lit(None).cast(kind).alias("first"), F.lit(True).alias("late"))
        repeated = repeated.unionByName(late)
    repeated = repeated.groupBy("h1", "h2").agg(F.max("first").alias("first"), F.max("late").alias("late"))
    repeated = stored(repeated, "lines-repeated")
    goes = F.col("late") | (F.col("doc") != F.col("first"))
    gone = (
        _lines(given, least_equal)
        .select("doc", *_hashes(line))
        .join(checked(repeated), ["h1", "h2"])
        .filter(goes)
        .groupBy("doc")
        .agg(F.collect_set("h1").alias("gone"))
    )
    # A row stands for itself, by its number.
    gone = stored(gone.select(F.col("doc.number").alias(key), F.col("gone").alias(gone_name)), "lines-gone")
    small = gone.agg(F.coalesce(F.sum(F.size(gone_name) + 4), F.lit(0))).head()[0] <= 2 * BROADCAST_ROWS
    text = F.col(text_column)
    lines_of = F.split(text, "\n")
    left = _rebuilt(text, F.coalesce(gone_name, F.array().cast("array<bigint>")), least_equal)
    changes = F.col(gone_name).isNotNull() | (F.size(lines_of) > F.size(F.array_distinct(lines_of)))
    same = F.col(f"{mark}number") == F.col(key)
    joined = docs.join(F.broadcast(gone) if small else gone, same, "left")
    rebuilt = joined.select(
        *columns, F.size(lines_of).alias(lines_name), F.when(changes, left).alias(left_name)
    )
    whole = F.when(F.col(left_name).isNull(), text).otherwise(F.col(f"{left_name}.text"))
    return rebuilt.select(
        *(whole.alias(c) if c == text_column else c for c in columns),
        F.coalesce(F.col(lines_name) - F.col(f"{left_name}.lines"), F.lit(0)).alias("lines_gone"),
    )
