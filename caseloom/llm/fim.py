"""Fill-in-middle: documents cut into prefix, middle and suffix at line ends, and put into another order.

The tokenizers library's Split pre-tokenizer cuts a text into units, isolated matches of a pattern, and gives their
code-point offsets; nothing is trained. Four numbers of a digest of seed and id rank two unit borders, and with them
two offsets, between which the middle lies; they also decide whether a text stays plain, and the order of its parts.
A form is one of plain (the text), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), each part behind
its mark. A text that holds a mark stays plain, so that every output can be told apart again: ``restore`` gives the
text back from output and form.

Rows are worked on where they are, without a shuffle. Long texts go through the library in stretches that end at
line ends, so memory beyond the text is bounded but for a single huge line. Null text counts as empty, and empty
texts are plain with n 0. A null id counts as the empty string in the digest. Repeated rows give repeated results,
an empty table gives none. Columns named as results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, schema_with

LINES = r"[^\n]*\n|[^\n]+"
#: Of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"
#: A stretch given to the library ends at the first line end behind so many characters.
STRETCH = 1 << 20


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """(offset, part) of consecutive parts that end at line ends."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + size) + 1 or len(text)
        yield at, text[at:end]
        at = end


def unit_ends(splitter, text: str) -> list[int]:
    """Code-point offsets at which units end."""
    return [at + span[1] for at, part in stretches(text) for _, span in splitter.pre_tokenize_str(part)]


def arrange(prefix: str, middle: str, suffix: str, form: str, marks: tuple[str, str, str]) -> str:
    p, s, m = marks
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def digest_numbers(seed: int, id_col: Column) -> Column:
    """The first four groups of eight hex digits of the digest of seed and id, as whole numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = LINES,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and output.

    Of 100 texts about rate are transformed, and of 100 of those about spm_rate take the form spm. No match of pattern
    may reach over a line end.
    """
    if len({*marks}) < 3 or any(a and a in b for a in marks for b in marks if a != b) or not all(marks):
        raise ValueError("marks must be three texts, none within another")
    added = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [c for c in docs.columns if c.lower() not in added and c.lower() != "fim_numbers"]
    schema = schema_with(docs.select(*[F.col(f"`{c}`") for c in kept]), ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        splitter = Split(Regex(pattern), "isolated")
        for b in batches:
            units, forms, prefixes, middles, outputs = [], [], [], [], []
            for text, numbers in zip(b.column(text_col), b.column(len(kept)), strict=True):
                text, (h1, h2, h3, h4) = text.as_py() or "", numbers.as_py()
                ends = [0, *unit_ends(splitter, text)]
                n = len(ends) - 1
                plain = not text or any(m in text for m in marks) or h3 % 100 >= rate
                first, last = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
                form = "plain" if plain else "spm" if h4 % 100 < spm_rate else "psm"
                units.append(n)
                forms.append(form)
                prefixes.append(None if plain else first)
                middles.append(None if plain else last - first)
                outputs.append(text if plain else arrange(text[:first], text[first:last], text[last:], form, marks))
            more = [pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())]
            yield beside(b.columns[: len(kept)], more, schema)

    return docs.select(*[F.col(f"`{c}`") for c in kept], digest_numbers(seed, F.col(id_col)).alias("fim_numbers")).mapInArrow(run, schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which an output of this form was made."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
