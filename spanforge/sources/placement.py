"""Where reported values stand in their texts: as they are, percent-escaped, decoded, as a key block or as a database address.

Reports become searches (rules, then one or two searches a report). All
searches of a text go through it together: one automaton finds all values,
overlapping ones too. Values that were found in decoded text go along a
frontier of encoded runs, one layer of decoding a round, each row with the bytes of
the text that it comes from. Equal reports then claim the places that were found in order.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.codecs import base64_lenient, base64_strict, uri_component
from spanforge.sources.store import discard, materialize

#: Searches of one text that go through it together; a text with more is read several times, in other tasks.
MOST_VALUES = 4096

#: Kinds of searches, reasons, limits of decoding, shapes of encoded runs, key blocks and escapes.
PLAIN, DECODED, DECODED_LINE, KEY_BLOCK, ADDRESS = "plain", "decoded", "decoded-line", "key-block", "address"
UNKNOWN_PATH, AMBIGUOUS = "unknown-path", "ambiguous-location"
SEGMENT, SEGMENT_EXTENDED, BLOCK = "source-segment", "source-segment-extended", "source-block"
MAX_LAYERS = 4
MAX_RUNS = 4096
RUNS = {"base64": re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}"), "hex": re.compile(r"[0-9A-Fa-f]{16,}")}
_KIND = "(?:(?:RSA|DSA|EC|OPENSSH|ENCRYPTED) )?PRIVATE KEY"
_BLOCK = re.compile(rf"-----BEGIN ({_KIND})-----(\r?\n)([A-Za-z0-9+/]+={{0,2}})(\r?\n)-----END ({_KIND})-----")
_ESCAPE = re.compile(rb"%[0-9A-Fa-f]{2}")
_SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ADDRESS = re.compile(rf"\b(?i:postgres(?:ql)?)://[^{_SPACE}]+\b", re.A)
_PARTS = re.compile(r"(?i:postgres(?:ql)?)://([^/?#]*)([^?#]*)")
DEFAULT_PORT = "5432"

MAPPING = "struct<bound: string, layers: int, codecs: array<string>>"
KEY = ["path", "kind", "value", "line", "codecs", "least", "most"]
SEARCH = "path string, kind string, value string, line bigint, codecs array<string>, least int, most int"


# ---------------------------------------------------------------- rules: from report rows to searches


@dataclass(frozen=True)
class Part:
    """A value to be searched; ``keeps``: whether its place is a finding, or only has to exist."""

    value: Column
    line: Column
    kind: str = PLAIN
    keeps: bool = True
    codecs: Column | None = None
    least: Column | None = None
    most: Column | None = None


@dataclass(frozen=True)
class RowRule:
    """For rows that it applies to: the parts of a row that fits, or the reason why it can't be placed. Tried in order."""

    applies: Column
    fits: Column
    parts: tuple[Part, ...]
    reason: str = AMBIGUOUS


def searches(rows: DataFrame, rules: list[RowRule]) -> DataFrame:
    """The searches of each row by the first rule that applies: the row's columns, part, keeps, those of KEY but path, reason; the latter replace the row's.

    Rows that no rule applies to, or whose first one they don't fit, have one search with a reason and no value.
    """

    def search(k: int, part: Part, reason: Column) -> Column:
        none = F.lit(None)
        values = {
            "part": F.lit(k), "keeps": F.lit(part.keeps), "kind": F.lit(part.kind), "value": part.value, "line": part.line.cast("long"),
            "codecs": none.cast("array<string>") if part.codecs is None else part.codecs,
            "least": none.cast("int") if part.least is None else part.least.cast("int"),
            "most": none.cast("int") if part.most is None else part.most.cast("int"),
            "reason": reason,
        }
        return F.struct(*[v.alias(name) for name, v in values.items()])

    def failed(reason: str) -> Column:
        return F.array(search(0, Part(F.lit(None).cast("string"), F.lit(None)), F.lit(reason)))

    chosen = failed(AMBIGUOUS)
    for rule in reversed(rules):
        parts = F.array(*[search(k, p, F.lit(None).cast("string")) for k, p in enumerate(rule.parts)])
        chosen = F.when(F.coalesce(rule.applies, F.lit(False)), F.when(F.coalesce(rule.fits, F.lit(False)), parts).otherwise(failed(rule.reason))).otherwise(chosen)
    made = ("part", "keeps", "kind", "value", "line", "codecs", "least", "most", "reason")
    return rows.withColumn("search", F.explode(chosen)).select(*[F.col(f"`{c}`") for c in rows.columns if c not in made], *[F.col(f"search.{c}") for c in made])


def pair_rule(applies: Column, value: Column, whole: Column, pattern: str, line: Column) -> RowRule:
    """Two findings from one row: ``pattern`` splits the whole into two groups, the first is the value; the second may be on any line."""
    first, second = (F.regexp_extract(whole, pattern, k) for k in (1, 2))
    return RowRule(applies, whole.rlike(pattern) & (value == first), (Part(first, line), Part(second, F.lit(None))))


def joined_rule(applies: Column, value: Column, pattern: str, line: Column) -> RowRule:
    """One finding from a value that joins two: the first group is the finding, the second only has to be in the text."""
    first, second = (F.regexp_extract(value, pattern, k) for k in (1, 2))
    return RowRule(applies, value.rlike(pattern), (Part(second, F.lit(None), keeps=False), Part(first, line)))


# ---------------------------------------------------------------- one text, all its searches


def _bytes_at(text: str, offsets: list[int]) -> dict[int, int]:
    """UTF-8 offsets of code point offsets."""
    out, at, size = {}, 0, 0
    for o in sorted(set(offsets)):
        size, at = size + len(text[at:o].encode("utf-8", "surrogatepass")), o
        out[o] = size
    return out


def escape_pattern(value: bytes) -> bytes:
    """Each escape of a printable character as an escape in either case or as the character; others in either case; the rest as it is."""
    out, last = [], 0
    for m in _ESCAPE.finditer(value):
        out.append(re.escape(value[last : m.start()]))
        either = b"(?i:" + re.escape(m[0]) + b")"
        byte = int(m[0][1:], 16)
        out.append(b"(?:" + either + b"|" + re.escape(bytes([byte])) + b")" if 0x20 <= byte < 0x7F else either)
        last = m.end()
    return b"".join([*out, re.escape(value[last:])])


def _escaped(raw: bytes, value: bytes, anchor: tuple[int, bytes], spots: list[int]) -> list[tuple[int, int]]:
    """Matches of a value with escapes that don't overlap, where its longest literal piece stands at one of the spots.

    anchor: how many bytes and escapes of the value come before the piece. Without a piece the whole text is searched.
    """
    pattern = re.compile(escape_pattern(value), re.S)
    if not anchor[1]:
        return [m.span() for m in pattern.finditer(raw)]
    before = value[: anchor[0]]
    escapes = len(_ESCAPE.findall(before))
    starts = {at - len(before) + 2 * k for at in spots for k in range(escapes + 1)}
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if s >= 0 and (not out or s >= out[-1][1]) and (m := pattern.match(raw, s)):
            out.append(m.span())
    return out


def _anchor(value: bytes) -> tuple[int, bytes]:
    best, last = (0, b""), 0
    for m in [*_ESCAPE.finditer(value), None]:
        end = m.start() if m else len(value)
        if end - last > len(best[1]):
            best = (last, value[last:end])
        last = m.end() if m else end
    return best


def address_key(address: str) -> tuple[tuple[str, str, str, str], str] | None:
    """(user, password, host, port) and database of a database address with a password; None if it is none."""
    m = _PARTS.match(address)
    if not m:
        return None
    who, _, where = m[1].rpartition("@")
    user, _, password = who.partition(":")
    host, colon, port = where.rpartition(":") if re.search(r":[0-9]*$", where) else (where, "", "")
    if not password or re.search(r"[\x00-\x20<>^|\\%:\[\]]", host) and not re.fullmatch(r"\[[0-9A-Fa-f:.]+\]", host) or port and int(port) > 65535:
        return None
    parts = [uri_component(user), uri_component(password), host, str(int(port)) if port else DEFAULT_PORT]
    database = uri_component(m[2].removeprefix("/"))
    return None if None in parts or database is None else (tuple(parts), database)


class _Text:
    """A text that several searches read."""

    def __init__(self, content: str):
        self.content = content
        self.raw = content.encode("utf-8", "surrogatepass")
        self._ends = None

    def line(self, byte: int) -> int:
        if self._ends is None:
            self._ends = [m.start() for m in re.finditer(b"\n", self.raw)]
        low, high = 0, len(self._ends)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self._ends[mid] < byte else (low, mid)
        return low + 1

    def blocks(self) -> dict[str, list[tuple[int, int]]]:
        """Key blocks by the text that their decoded body makes."""
        out: dict[str, list[tuple[int, int]]] = {}
        found = []
        for m in _BLOCK.finditer(self.content):
            if m[1] == m[5]:
                data = base64_lenient(m[3])
                if base64.b64encode(data).decode() == m[3]:
                    try:
                        found.append((m.start(), m.end(), f"-----BEGIN {m[1]}-----{m[2]}{data.decode()}{m[4]}-----END {m[1]}-----"))
                    except UnicodeDecodeError:
                        continue
        at = _bytes_at(self.content, [x for s, e, _ in found for x in (s, e)])
        for s, e, text in found:
            out.setdefault(text, []).append((at[s], at[e]))
        return out

    def addresses(self) -> dict[tuple, list[tuple[int, int, str]]]:
        found = [(m.start(), m.end(), address_key(m[0])) for m in _ADDRESS.finditer(self.content)]
        at = _bytes_at(self.content, [x for s, e, key in found if key for x in (s, e)])
        out: dict[tuple, list[tuple[int, int, str]]] = {}
        for s, e, key in found:
            if key:
                out.setdefault(key[0], []).append((at[s], at[e], key[1]))
        return out

    def in_decoded_line(self, value: str, line: int | None) -> list[tuple[int, int]]:
        """Places of a value in a line, one of whose base64 runs is replaced by what it decodes to; the value overlaps that."""
        lines = self.content.split("\n")
        if not value or line is None or not 1 <= line <= len(lines):
            return []
        text, first = lines[line - 1], sum(len(x) + 1 for x in lines[: line - 1])
        found = []
        for m in RUNS["base64"].finditer(text):
            standard = m[0].replace("-", "+").replace("_", "/")
            data = base64_lenient(standard)
            if base64.b64encode(data).rstrip(b"=").decode() != standard.rstrip("="):
                continue
            try:
                decoded = data.decode()
            except UnicodeDecodeError:
                continue
            # What stands before and after the run matters as far as the value reaches.
            near = max(0, m.start() - len(value))
            whole = text[near : m.start()] + decoded + text[m.end() : m.end() + len(value)]
            run, end_of_run = m.start() - near, m.start() - near + len(decoded)
            at = whole.find(value)
            while at >= 0:
                stop = at + len(value)
                if stop > run and at < end_of_run:
                    found.append((first + near + min(run, at), first + m.end() + max(0, stop - end_of_run)))
                at = whole.find(value, at + 1)
        at = _bytes_at(self.content, [x for pair in found for x in pair])
        return [(at[s], at[e]) for s, e in found]


def place_all(content: str, asked: list[dict]) -> list[list[tuple[int, int]]]:
    """For each search of a text (kind, value, line) the byte ranges where it stands."""
    text = _Text(content)
    automaton, wanted = ahocorasick.Automaton(), {}
    for i, q in enumerate(asked):
        if q["kind"] == PLAIN and q["value"]:
            value = q["value"].encode("utf-8", "surrogatepass")
            wanted.setdefault(value, []).append(i)
            if _ESCAPE.search(value) and (anchor := _anchor(value))[1]:
                wanted.setdefault(anchor[1], [])
    spots: dict[bytes, list[int]] = {v: [] for v in wanted}
    for v in wanted:
        automaton.add_word(v.decode("latin-1"), v)
    if wanted:
        automaton.make_automaton()
        for end, v in automaton.iter(text.raw.decode("latin-1")):
            spots[v].append(end + 1 - len(v))
    out: list[list[tuple[int, int]]] = [[] for _ in asked]
    for value, which in wanted.items():
        if which:
            found = [(s, s + len(value)) for s in spots[value]]
            if not found and _ESCAPE.search(value):
                anchor = _anchor(value)
                found = _escaped(text.raw, value, anchor, spots.get(anchor[1], []))
            for i in which:
                out[i] = found
    blocks = text.blocks() if any(q["kind"] == KEY_BLOCK for q in asked) else {}
    addresses = text.addresses() if any(q["kind"] == ADDRESS for q in asked) else {}
    for i, q in enumerate(asked):
        value = q["value"] or ""
        if q["kind"] == KEY_BLOCK:
            out[i] = [] if q["line"] is None else blocks.get(value, [])
        elif q["kind"] == ADDRESS:
            key = address_key(value)
            named = (q["codecs"] or [None])[0]  # the database, if the report names it
            out[i] = [(s, e) for s, e, name in addresses.get(key[0], []) if named is None or name == named] if key else []
        elif q["kind"] == DECODED_LINE:
            out[i] = text.in_decoded_line(value, q["line"])
        if q["line"] is not None and q["kind"] != DECODED_LINE:
            out[i] = [(s, e) for s, e in out[i] if text.line(s) == q["line"]]
    return out


# ---------------------------------------------------------------- the frontier of decoded runs


def decode_run(run: str, codec: str) -> str | None:
    """Strictly: alphabet, padding and form are read off the run; the result is UTF-8."""
    if codec == "hex":
        if len(run) % 2:
            return None
        data = bytes.fromhex(run)
    else:
        url = "-" in run or "_" in run
        if url and ("+" in run or "/" in run):
            return None
        data = base64_strict(run, url, run.endswith("="))
    try:
        return None if data is None else data.decode()
    except UnicodeDecodeError:
        return None


def expand_runs(text: str, codec: str) -> str | None:
    """Every run of the codec that decodes strictly is replaced by what it decodes to; None if there is none."""
    some = False

    def replaced(m: re.Match) -> str:
        nonlocal some
        decoded = decode_run(m[0], codec)
        some |= decoded is not None
        return m[0] if decoded is None else decoded

    out = RUNS[codec].sub(replaced, text)
    return out if some else None


_FRONTIER = "path string, start_byte bigint, end_byte bigint, line bigint, chain array<string>, text string"
_FRONTIER_ARROW = pa.schema([("path", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("line", pa.int64()), ("chain", pa.list_(pa.string())), ("text", pa.string())])
_BATCH = 1000


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= _BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def encoded_runs(cases: DataFrame) -> DataFrame:
    """The frontier before any decoding: each maximal run of a codec with its bytes, line, and the codec as chain."""

    def run(batches):
        def rows():
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    text = _Text(content)
                    for codec, pattern in RUNS.items():
                        found = [(m.start(), m.end(), m[0]) for m in pattern.finditer(content)]
                        at = _bytes_at(content, [s for s, _, _ in found])
                        for s, e, value in found:
                            yield {"path": path, "start_byte": at[s], "end_byte": at[s] + e - s, "line": text.line(at[s]), "chain": [codec], "text": value}

        yield from _batched(rows(), _FRONTIER_ARROW)

    return cases.where("content is not null").select("path", "content").mapInArrow(run, _FRONTIER)


def next_layer(frontier: DataFrame, first: bool) -> DataFrame:
    """One layer more: whole runs first, then every run inside a decoded text, by each codec. Rows that don't decode end there."""

    def run(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    if first:
                        if (text := decode_run(r["text"], r["chain"][0])) is not None:
                            yield r | {"text": text}
                    else:
                        for codec in RUNS:
                            if (text := expand_runs(r["text"], codec)) is not None:
                                yield r | {"text": text, "chain": [*r["chain"], codec]}

        yield from _batched(rows(), _FRONTIER_ARROW)

    return frontier.mapInArrow(run, _FRONTIER)


def _decoded_places(asked: DataFrame, cases: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(KEY, start_byte, end_byte, layers, used) of the searches of decoded values: segments that decode to a text with the value, by their first chain.

    A search with more than MAX_RUNS runs on its line has no place.
    """
    texts = cases.join(asked.select("path").distinct(), "path", "left_semi")
    runs = materialize(encoded_runs(texts), "runs")
    spot = ["path", "line", "start_byte", "end_byte"]
    by_line = runs.select(*spot, F.explode("chain").alias("codec")).groupBy(*spot).agg(F.collect_set("codec").alias("codecs"))
    grouped = by_line.groupBy("path", "line").agg(*[F.count_if(F.arrays_overlap("codecs", F.array(*[F.lit(c) for c in some]))).alias("_".join(some)) for some in (["base64"], ["hex"], ["base64", "hex"])])
    totals = grouped.groupBy("path").agg(F.lit(None).cast("long").alias("line"), *[F.sum(c).alias(c) for c in ("base64", "hex", "base64_hex")])
    counts = grouped.unionByName(totals).select("path", F.coalesce("line", F.lit(-1)).alias("at"), "base64", "hex", "base64_hex")
    n_runs = F.when(F.size("codecs") > 1, F.col("base64_hex")).when(F.array_contains("codecs", "hex"), F.col("hex")).otherwise(F.col("base64"))
    allowed = asked.withColumn("at", F.coalesce("line", F.lit(-1))).join(counts, ["path", "at"]).where(n_runs <= MAX_RUNS).select(*KEY)
    layers, stored = [], [runs]
    for k in range(MAX_LAYERS):
        layers.append(materialize(next_layer(stored[-1], first=k == 0), "frontier"))
        stored.append(layers[-1])
    frontier = reduce(DataFrame.unionByName, layers)
    # About MAX_RUNS rows of the frontier meet about MOST_VALUES searches in a task.
    sizes = frontier.groupBy("path").agg(F.ceil(F.count("*") / MAX_RUNS).alias("blocks")).join(_parts(allowed), "path")
    rows = frontier.join(sizes, "path").withColumn("block", F.pmod(F.xxhash64("start_byte", "end_byte"), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asking = _parted(allowed, sizes).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = ["path", "block", "part"]
    found = rows.drop("parts", "blocks").groupBy(*cell).cogroup(asking.select(*KEY, "block", "part").groupBy(*cell)).applyInArrow(_meet, f"{_KEYS}, start_byte bigint, end_byte bigint, chain array<string>")
    # A segment's first chain: fewest layers, then in order of the codecs.
    best = found.groupBy("key", "start_byte", "end_byte").agg(F.min(F.struct(F.size("chain").alias("layers"), "chain")).alias("best"))
    return best.select("key.*", "start_byte", "end_byte", "best.layers", F.array_sort(F.array_distinct("best.chain")).alias("used")), stored


_KEYS = "key struct<path: string, kind: string, value: string, line: bigint, codecs: array<string>, least: int, most: int>"
_KEY_ARROW = pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("line", pa.int64()), ("codecs", pa.list_(pa.string())), ("least", pa.int32()), ("most", pa.int32())])
_PLACE_ARROW = pa.schema([("key", _KEY_ARROW), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("chain", pa.list_(pa.string()))])


def _meet(frontier: pa.Table, asked: pa.Table) -> pa.Table:
    """The rows of the frontier whose text holds a value that is searched there, on its line, by its codecs and layers."""
    automaton, wanted = ahocorasick.Automaton(), {}
    for q in asked.select(KEY).to_pylist():
        wanted.setdefault(q["value"], []).append(q)
    out = []
    if wanted and frontier.num_rows:
        for v in wanted:
            automaton.add_word(v, v)
        automaton.make_automaton()
        for r in frontier.to_pylist():
            for v in {v for _, v in automaton.iter(r["text"])}:
                for q in wanted[v]:
                    if (q["line"] is None or q["line"] == r["line"]) and q["least"] <= len(r["chain"]) <= q["most"] and set(r["chain"]) <= set(q["codecs"]):
                        out.append({"key": q, "start_byte": r["start_byte"], "end_byte": r["end_byte"], "chain": r["chain"]})
    return pa.Table.from_pylist(out, _PLACE_ARROW)


def _parts(asked: DataFrame) -> DataFrame:
    return asked.groupBy("path").agg(F.ceil(F.count("*") / MOST_VALUES).alias("parts"))


def _parted(asked: DataFrame, sizes: DataFrame) -> DataFrame:
    return asked.join(sizes, "path").withColumn("part", F.pmod(F.xxhash64("value", "line"), "parts"))


def _plain_places(asked: DataFrame, cases: DataFrame) -> DataFrame:
    def run(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    for q, found in zip(r["asked"], place_all(r["content"], r["asked"])):
                        for s, e in found:
                            yield {"key": q, "start_byte": s, "end_byte": e, "chain": None}

        yield from _batched(rows(), _PLACE_ARROW)

    grouped = _parted(asked, _parts(asked)).groupBy("path", "part").agg(F.collect_list(F.struct(*KEY)).alias("asked")).drop("part")
    met = grouped.join(cases.where("content is not null").select("path", "content"), "path")
    found = met.mapInArrow(run, f"{_KEYS}, start_byte bigint, end_byte bigint, chain array<string>")
    return found.select("key.*", "start_byte", "end_byte")


# ---------------------------------------------------------------- places and claims


def place(asked: DataFrame, cases: DataFrame) -> DataFrame:
    """Add start_byte, end_byte, mapping and reason to searches (those of ``searches``, with path and emit_seq) of texts (path, content).

    A value with one place has it, for every report. Of several places the k-th
    report by emit_seq of an equal search takes the k-th, and a report beyond
    them is ambiguous; key blocks, addresses and values of decoded lines must have one place. A value with
    escapes that isn't in the text as it is matches where a text has characters for its escapes. A decoded value's place is the
    whole run that decodes to a text with it, in ``least`` to ``most`` layers (up to four) of its codecs, and says so in mapping.
    Empty and null values have no place; a search that came with a reason keeps it. Other columns stay.
    """
    given = asked.where("reason is not null").withColumns({"start_byte": F.lit(None).cast("long"), "end_byte": F.lit(None).cast("long"), "mapping": F.lit(None).cast(MAPPING)})
    wanted = asked.where("reason is null")
    keys = wanted.where("value <> ''").select(*KEY).distinct()
    decodes = (F.col("kind") == DECODED) & (F.col("least") >= 1) & (F.col("least") <= F.col("most")) & (F.col("most") <= MAX_LAYERS) & (F.size("codecs") > 0)
    plain = _plain_places(keys.where(F.col("kind") != DECODED), cases)
    decoded, _ = _decoded_places(keys.where(decodes), cases)
    mapping = F.when(F.col("kind") == KEY_BLOCK, BLOCK).when(F.col("kind") == DECODED_LINE, SEGMENT_EXTENDED)
    by_line = F.struct(mapping.alias("bound"), F.lit(1).alias("layers"), F.array(F.lit("base64")).alias("codecs"))
    plain = plain.withColumn("mapping", F.when(mapping.isNotNull(), by_line))
    decoded = decoded.withColumn("mapping", F.struct(F.lit(SEGMENT).alias("bound"), "layers", F.col("used").alias("codecs"))).drop("layers", "used")
    # A key is met by its digest, as nulls are parts of it.
    digest = F.sha2(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}), 256)
    spots = materialize(plain.unionByName(decoded).select(digest.alias("key"), "start_byte", "end_byte", "mapping"), "places")
    order = Window.partitionBy("key").orderBy("start_byte", "end_byte")
    ranked = spots.withColumn("rank", F.row_number().over(order))
    counts = spots.groupBy("key").agg(F.count("*").alias("places"))
    claims = wanted.withColumn("key", digest).withColumn("claim", F.row_number().over(Window.partitionBy("key").orderBy("emit_seq", "part")))
    only = F.col("kind").isin(KEY_BLOCK, ADDRESS, DECODED_LINE)
    taken = claims.join(counts, "key", "left").withColumn("rank", F.when(F.col("places") == 1, 1).when(~only & (F.col("claim") <= F.col("places")), F.col("claim")))
    known = cases.select("path", F.lit(True).alias("known")).distinct()
    placed = taken.join(ranked, ["key", "rank"], "left").join(known, "path", "left")
    reason = F.when(F.col("known").isNull(), UNKNOWN_PATH).when(F.col("start_byte").isNull(), AMBIGUOUS)
    return placed.withColumn("reason", reason).select(*asked.columns, "start_byte", "end_byte", "mapping").unionByName(given.select(*asked.columns, "start_byte", "end_byte", "mapping"))
