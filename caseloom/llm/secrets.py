"""Secret scans with DataFrame functions alone: fixed patterns, and character Markov models.

Long runs of letters, digits and a few marks are candidates. Two models of character pairs, one of random
strings and one of ordinary words and identifiers, give each candidate a log-likelihood ratio; candidates
above the margin are spans of kind ``random``. The models are trained from labelled samples: random strings
written from digests (as base64 text, as upper-case hexadecimal and as lower-case letters with digits), and
ordinary strings made of words as programmers and sites make them, with digits, capitals, dates and paths, rules and
alphabets in their order. The words come from a bounded sample of the corpus and from a fixed list. The margin falls
with the number of groups of digits (MARGINS); UUIDs of either case are ordinary. Patterns of well-known secrets
count whatever the models say. A candidate that reaches beyond each of them is judged by all its characters
outside of them together, and where that fails, by each part of LEAST_PART characters and more that they leave;
random spans may so overlap others.

Spans are in code points, end exclusive. Null text counts as empty and has no spans; texts of any length are
scanned whole, at a cost that hardly outgrows their length. Spans that start together are listed by kind. Each
row is judged by itself, so repeated rows give repeated results. An empty table stays empty. Columns named as
results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of secrets, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""\A(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Shorter runs seldom reach the margin, whatever they hold. Hexadecimal and access keys lie inside these runs.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
LEAST_PART = 16
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_VALUE = 12

#: Characters that a model knows; others count as one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CODES = 128
#: Log-likelihood ratio from which a candidate is a secret: a thousand to one.
MARGIN = math.log(1000)
#: The same for candidates without a group of digits, with one, two, and more: random strings of these alphabets have
#: several, so that without them more evidence is asked for. Names of parts no sample holds seldom have any.
MARGINS = (30.0, 20.0, 15.0, MARGIN)
#: UUIDs are ordinary by their shape.
UUID = r"(?i)\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
# Alphabets and digits in their order, forwards and backwards, as tables and tests write them.
SEQUENCES = [x for s in (ALPHABET[:26], ALPHABET[26:52], "0123456789ABCDEF", "0123456789abcdef") for x in (s, s[::-1])]
#: Taken from each pair's ratio: words of languages that no sample holds look a little random.
DISCOUNT = 0.75
#: Characters of a candidate, and of a text, that are handled as one block.
PAIR_BLOCK, TEXT_BLOCK = 64, 4096

# Words of names as programmers write them, so that the ordinary model knows them whatever the corpus.
WORDS = """access account action address after agent alert array asset async attribute author available backup base
batch before block board branch browser buffer build button cache calendar callback camera candidate case category
chain change channel check class client cluster code column command comment common component config connection
container content context control cookie count country create customer database date default delete description
detail device directory document domain download driver editor element email empty enable engine error event example
export factory feature field file filter folder format frame function gateway group handler header helper history
image import index input instance interface international invoice item java kernel language layout length library
license limit link list local location manager mapper master maximum memory message method metric minimum mobile
model module monitor name network number object offset option order output package page parameter parent password
path payment people picture platform plugin policy pool port prefix private process product profile project property
protocol provider proxy public python query queue record reference region release remote report request resource
response result return review router sample schema score script search section security select sequence server
service session setting shared signal simple socket source stack start state static status storage stream string
style subject support switch system table target task template test text thread time title topic total track traffic
transaction transport type unit update upload user utility validation value variable vendor version video view
wallet warning weather web week widget window worker workflow wrapper write year zone""".split()


SPAN = "struct<at:int,kind:int,end:int,body:string>"


NO_SPANS = f"CAST(array() AS array<{SPAN}>)"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def held(name: str, value: str, use: str) -> str:
    """SQL of use, in which name stands for value, computed once. Such long expressions are parsed faster than put together."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def running(values: str, add: bool) -> str:
    """SQL of the running sums, or else running greatest values, of an array of whole numbers.

    An aggregate that appends copies its array each time. So runs of about the square root of the length are
    done by themselves, and then put on top of each other.
    """
    none, least = "CAST(array() AS array<int>)", 0 if add else -1
    both = (lambda a, b: f"{a} + {b}") if add else (lambda a, b: f"greatest({a}, {b})")

    def plain(part: str) -> str:
        last = f"coalesce(try_element_at(out, -1), {least})"
        return f"aggregate({part}, {none}, (out, x) -> concat(out, array({both(last, 'x')})))"

    size = "CAST(ceil(sqrt(size(v))) AS int)"
    runs = f"transform(sequence(1, size(v), {size}), i -> {plain(f'slice(v, i, {size})')})"
    tops = f"concat(array({least}), {plain('transform(r, y -> element_at(y, -1))')})"
    joined = f"flatten(zip_with(r, {tops}, (part, top) -> transform(coalesce(part, {none}), x -> {both('top', 'x')})))"
    return held("v", values, f"CASE WHEN size(v) > 0 THEN {held('r', runs, joined)} ELSE {none} END")


def spans_of(text: str, pattern: str, kind: int) -> str:
    """SQL of structs (at, kind, end, body) of the leftmost non-overlapping matches: lengths of what lies between add up."""
    lengths = f"zip_with(found, slice(split({text}, {quoted(pattern)}, -1), 1, size(found)), (m, gap) -> length(m) + length(gap))"
    make = f"zip_with(found, {running(lengths, True)}, (m, stop) -> named_struct('at', stop - length(m), 'kind', {kind}, 'end', stop, 'body', m))"
    return f"CASE WHEN {text} RLIKE {quoted(pattern)} THEN {held('found', f'regexp_extract_all({text}, {quoted(pattern)}, 0)', make)} ELSE {NO_SPANS} END"


def pair_counts(strings: DataFrame, text_col: str) -> DataFrame:
    """pair (first code * CODES + second code), n."""
    code = lambda i: F.ascii(F.substring(F.col(text_col), i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.length(text_col) - 1), lambda i: code(i) * CODES + code(i + 1))
    return strings.where(F.length(text_col) > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def random_strings(like: DataFrame, n: int) -> DataFrame:
    """Labelled sample of random strings, written from digests."""
    ids = like.sparkSession.range(n)
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    lower = F.lower(F.regexp_replace(base64, "[+/]", ""))
    forms = F.array(F.substring(base64, 1, 40), F.substring(F.translate(base64, "+/", "-_"), 1, 40), F.upper(F.substring(digest, 1, 32)), F.substring(lower, 1, 24))
    return ids.select(F.explode(forms).alias("s"))


def ordinary_forms(words: DataFrame) -> DataFrame:
    """Labelled sample of ordinary strings: s, one a row of words (w, next), in a form that a hash of both chooses."""
    w, u = F.col("w"), F.col("next")
    draw = lambda salt, n: F.pmod(F.xxhash64(w, u, F.lit(salt)), F.lit(n)).cast("int")
    digits = lambda salt, n: F.lpad(draw(salt, 10**n).cast("string"), n, "0")
    day = F.date_add(F.lit("1990-01-01").cast("date"), draw("day", 20000))
    digest = F.md5(F.concat(w, F.lit(":"), u).cast("binary"))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    forms = [
        w,
        F.concat(w, u),
        F.concat_ws("_", w, u),
        F.concat_ws("-", w, u, F.lower(w)),
        F.concat(w, F.initcap(u), F.initcap(w)),
        F.concat(F.lower(w), F.initcap(u)),
        F.concat(F.initcap(u), F.initcap(w)),
        F.upper(F.concat_ws("_", w, u, w)),
        F.upper(F.concat_ws("_", w, digits("a", 4), u, digits("b", 2))),
        F.concat_ws("_", w, digits("c", 6), u),
        F.concat(w, draw("d", 100).cast("string"), F.lit("-"), u, draw("e", 10).cast("string")),
        F.concat_ws("/", w, u, F.date_format(day, "yyyy/MM/dd"), F.concat_ws("-", u, w, F.year(day).cast("string"))),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(day, 31), "yyyy-MM-dd")),
        F.concat_ws("-", digits("f", 4), digits("g", 4), digits("h", 4), digits("i", 4)),
        F.concat(digits("j", 9), digits("k", 9)),
        F.concat_ws("-", *parts),
        F.concat(F.lit("/"), w, F.lit("/"), u, F.lit("/"), F.initcap(w)),
    ]
    chosen = F.when(F.col("form") == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        chosen = chosen.when(F.col("form") == i, form)
    return words.withColumn("form", draw("form", len(forms))).select(chosen.alias("s"))


def ordinary_words(docs: DataFrame, text_col: str, sample_docs: int) -> DataFrame:
    """w, next: neighbouring words of about sample_docs documents, and of the fixed list."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.col(text_col), F.lit("secrets")), F.lit(1 << 20)) < share * (1 << 20)
    # Rows of equal text are drawn together, so each text counts once: the sample stays bounded.
    found = docs.where(drawn).select(text_col).distinct().select(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{3,15}(?![A-Za-z0-9+/_-])"), F.lit(0)).alias("all"))
    pairs = found.select(F.explode(F.transform("all", lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get("all", i + 1), w).alias("next")))).alias("p")).select("p.*")
    n = len(WORDS)
    fixed = docs.sparkSession.createDataFrame([(w, WORDS[(7 * i + 13 * k + k * i) % n]) for i, w in enumerate(WORDS) for k in range(16)], "w string, next string")
    return pairs.unionByName(fixed)


def log_ratios(docs: DataFrame, text_col: str = "text", random_rows: int = 2000, sample_docs: int = 500) -> list[float]:
    """For each pair of codes, the log of its probability among random strings over that among ordinary ones, less DISCOUNT."""
    spark = docs.sparkSession
    rules = spark.createDataFrame([(c * 24,) for c in ALPHABET], "s string").select(F.explode(F.array_repeat("s", 50)).alias("s"))  # as lines are drawn
    orders = spark.createDataFrame([(x,) for x in SEQUENCES], "s string").select(F.explode(F.array_repeat("s", 300)).alias("s"))
    samples = [random_strings(docs, random_rows), ordinary_forms(ordinary_words(docs, text_col, sample_docs)).unionByName(rules).unionByName(orders)]
    known = [ord(c) for c in ALPHABET]
    logs = []
    for s in samples:
        n = {r[0]: r[1] for r in pair_counts(s, "s").collect()}
        rows = {a: sum(n.get(a * CODES + b, 0) for b in known) + len(known) * 0.5 for a in known}
        logs.append({(a, b): math.log((n.get(a * CODES + b, 0) + 0.5) / rows[a]) for a in known for b in known})
    table = [0.0] * (CODES * CODES)
    for a, b in logs[0]:
        table[a * CODES + b] = logs[0][a, b] - logs[1][a, b] - DISCOUNT
    return table


def blocks(text: Column, size: int) -> Column:
    """A text cut into blocks of so many characters: a substring is found by walking from a text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def ratio(body: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a candidate, which holds ASCII alone."""
    values = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")

    def pairs(text: Column) -> Column:
        code = lambda i: F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(F.length(text) > 1, F.aggregate(F.sequence(F.lit(2), F.length(text)), F.lit(0.0), lambda s, i: s + F.get(values, code(i - 1) * CODES + code(i)))).otherwise(0.0)

    start = F.struct(F.lit(0.0).alias("r"), F.lit("").alias("last"))
    add = lambda s, b: F.struct((s["r"] + pairs(F.concat(s["last"], b))).alias("r"), F.substring(b, -1, 1).alias("last"))
    return F.when(F.length(body) <= PAIR_BLOCK, pairs(body)).otherwise(F.aggregate(blocks(body, PAIR_BLOCK), start, add, lambda s: s["r"]))


def outside(s: str, crossed: str) -> str:
    """SQL of the parts of a span s, of two characters and more, that no span of crossed, sorted by start, covers."""

    def part(stop: str) -> str:
        span = f"named_struct('at', state.pos, 'kind', {s}.kind, 'end', {stop}, 'body', substring({s}.body, state.pos - {s}.at + 1, {stop} - state.pos))"
        return f"CASE WHEN {stop} - state.pos > 1 THEN concat(state.out, array({span})) ELSE state.out END"

    start = f"named_struct('pos', {s}.at, 'out', {NO_SPANS})"
    add = f"named_struct('pos', greatest(state.pos, b.end), 'out', {part('b.at')})"
    return f"CASE WHEN size({crossed}) = 0 THEN array({s}) ELSE aggregate({crossed}, {start}, (state, b) -> {add}, state -> {part(f'{s}.end')}) END"


def crossing(candidates: str, assign: str) -> str:
    """SQL of structs (span, crossed) of candidates that no single base span covers; crossed: base spans over a part of them, by start.

    Access and hexadecimal keys hold characters of candidates alone, so they lie inside one. An assignment that
    starts inside a candidate reaches beyond its end, so it is the next span by start; another may reach into it
    from before, as far as the greatest end so far.
    """
    plain = lambda at, kind, end: f"named_struct('at', {at}, 'kind', {kind}, 'end', {end}, 'body', '')"
    before, after = "get(reach, i)", "get(ev, i + 1)"
    left = f"CASE WHEN {before} > e.at THEN array({plain('e.at', 0, f'least({before}, e.end)')}) ELSE {NO_SPANS} END"
    right = f"CASE WHEN {after}.at < e.end THEN array({plain(f'{after}.at', 0, 'e.end')}) ELSE {NO_SPANS} END"
    keys = f"concat({spans_of('e.body', ACCESS, 1)}, {spans_of('e.body', HEX, 2)})"
    inner = f"transform({keys}, b -> {plain('b.at + e.at', 1, 'b.end + e.at')})"
    made = f"named_struct('span', e, 'crossed', array_sort(concat({left}, {inner}, {right})))"
    reached = running("transform(ev, e -> CASE WHEN e.kind = 0 THEN e.end ELSE -1 END)", False)
    listed = f"transform(ev, (e, i) -> CASE WHEN e.kind = 3 THEN {made} END)"
    found = held("ev", f"array_sort(concat({candidates}, {assign}))", held("reach", reached, listed))
    return f"filter({found}, c -> c IS NOT NULL AND NOT exists(c.crossed, b -> b.at <= c.span.at AND c.span.end <= b.end))"


def spans(docs: DataFrame, text_col: str = "text", table: list[float] | None = None, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """docs with spans added: structs (at, kind, end, body) by start, then kind; kind indexes KINDS.

    margins: the ratio asked of candidates with 0, 1, ... groups of digits; the last holds for all further numbers.
    """
    table = log_ratios(docs, text_col) if table is None else table
    columns = [c for c in docs.columns if c.lower() != "spans"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("k_row"), F.coalesce(F.col(text_col), F.lit("")).alias("k_text"))
    assign = f"filter({spans_of('k_text', ASSIGN, 0)}, s -> length(regexp_replace(s.body, {quoted(ASSIGN_HEAD)}, '')) >= {ASSIGN_VALUE})"
    base = own.select("k_row", "k_text", F.expr(assign).alias("k_assign"), F.expr(f"concat({spans_of('k_text', ACCESS, 1)}, {spans_of('k_text', HEX, 2)})").alias("k_keys"))
    candidates = base.select("k_row", F.array_sort(F.concat("k_assign", "k_keys")).alias("k_base"), F.expr(crossing(spans_of("k_text", CANDIDATE, 3), "k_assign")).alias("k_more"))
    of_body = lambda p: F.when(p["body"].rlike(UUID), -math.inf).otherwise(ratio(p["body"], table))
    judge = lambda p: F.struct(p.alias("span"), of_body(p).alias("r"), F.regexp_count(p["body"], F.lit("[0-9]+")).alias("groups"))
    asked = lambda groups: F.element_at(F.array(*map(F.lit, margins)), F.least(groups, F.lit(len(margins) - 1)) + 1)
    judged = candidates.withColumn("k_parts", F.expr(f"transform(k_more, c -> {outside('c.span', 'c.crossed')})")).withColumn("k_parts", F.transform("k_parts", lambda parts: F.transform(parts, judge)))
    random = lambda p: (p["r"] >= asked(p["groups"])) & (p["span"]["end"] - p["span"]["at"] >= LEAST_PART)
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda r, p: r + p["r"])
    whole = lambda parts: total(parts) >= asked(F.aggregate(parts, F.lit(0), lambda n, p: n + p["groups"]))
    more = F.flatten(F.zip_with("k_more", "k_parts", lambda c, parts: F.when(whole(parts), F.array(c["span"])).otherwise(F.transform(F.filter(parts, random), lambda p: p["span"]))))
    return judged.select("k_row.*", F.array_sort(F.concat("k_base", more)).alias("spans"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["at"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", table: list[float] | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with each span of a text, overlapping ones as one, replaced by mask."""
    found = spans(docs, text_col, table)
    text = F.col(text_col)
    # A span that starts at or behind all ends before it begins a cut, which ends where the last span before the next does.
    reached = found.withColumn("k_end", F.expr(running("transform(spans, s -> s.end)", False)))
    begins = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: (i == 0) | (F.get("spans", i)["at"] >= F.get("k_end", i - 1)))
    first = reached.withColumn("k_first", F.when(F.size("spans") > 0, begins)).withColumn("k_block", F.when(F.size("spans") > 0, blocks(text, TEXT_BLOCK)))
    start = lambda j: F.when(j > 0, F.get("k_end", F.coalesce(F.get("k_first", j), F.size("spans")) - 1)).otherwise(0)
    end = lambda j: F.coalesce(F.get("spans", F.get("k_first", j))["at"], F.length(text))

    def piece(a: Column, b: Column) -> Column:
        block = lambda x: F.floor(x / TEXT_BLOCK).cast("int")
        whole = F.array_join(F.slice("k_block", block(a) + 1, block(b) - block(a) + 1), "")
        return F.substring(whole, a - block(a) * TEXT_BLOCK + 1, b - a)

    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.size("k_first")), lambda j: piece(start(j), end(j))), mask)
    return first.select(*[(F.when(F.size("spans") > 0, cut).otherwise(text) if c == text_col else F.col(f"`{c}`")).alias(c) for c in found.columns if c != "spans"])
