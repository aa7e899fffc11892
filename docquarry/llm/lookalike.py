"""One form for texts that look the same.

Look-alike classes are built by union-find over code points and strings:
canonical compositions, wide and narrow forms, presentation ligatures, kinds
of blank, and letters of different scripts with one shape. Texts are taken
apart canonically, so a class holds for a letter with and without its accents.
Each class is represented by the member that the corpus uses most, and texts
are rewritten greedily, longest match first, by a multi-pattern automaton. No
pattern holds a blank or a line feed, so words are rewritten each for itself,
and a task rewrites a word it has met before by looking it up.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.materialize import materialize

# Letters of one shape, by script: Latin letters and the letters that look like them.
SAME_SHAPE = [
    # Cyrillic
    ("ABCEHIJKMOPSTXYQWVG", "АВСЕНІЈКМОРЅТХҮԚԜѴԌ"), ("aceijopsxyhdqwlv", "асеіјорѕхуһԁԛԝӏѵ"), ("YIy", "УӀү"),
    # Greek
    ("ABEZHIKMNOPTYXC", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"), ("aovpuycj", "αονρυγϲϳ"), ("µк", "μκ"), ("к", "ĸ"),
    # Armenian
    ("OUSLouhngjq", "ՕՍՏԼօսհոցյզ"),
    # Cherokee
    ("DRTAJEWMHYGZRWSVSLCPKB", "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ"),
    # Lisu
    ("BPDTGKJCZFMNLSRVHWXYAEIOU", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"),
    # Coptic
    ("OCPXNMKHopc", "ⲞⲤⲢⲬⲚⲘⲔⲎⲟⲣⲥ"),
    # other Latin letters
    ("agcovwz", "ɑɡᴄᴏᴠᴡᴢ"),
]
# Strings that look like one letter or mark.
SAME_STRING = [("i", "i\u0307"), ("j", "j\u0307"), ("-", "\u2010"), ("-", "\u2011"), ("°C", "\u2103"), ("°F", "\u2109")]
BLANK = "\t\v\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BREAKS = re.compile("\r\n|[\r\u0085\u2028\u2029]")
HIDDEN_EXTRA = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
#: Ranges of compatibility characters that look like their parts: Roman numerals, digraphs and ligatures.
LIKE_PARTS = ((0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C4, 0x01CC))
MEMO_WORDS, MEMO_CHARS = 200_000, 64


def hidden(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or c in HIDDEN_EXTRA or (o < 32 and c not in "\t\n\v\f\r") or 0x7F <= o < 0xA0 and o != 0x85


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, s: str) -> str:
        up = self.up
        up.setdefault(s, s)
        while up[s] != s:
            up[s] = up[up[s]]
            s = up[s]
        return s

    def join(self, a: str, b: str) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def apart(s: str) -> str:
    return unicodedata.normalize("NFD", s)


def build_classes() -> Classes:
    """Classes of strings, each taken apart canonically."""
    found = Classes()
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        way = unicodedata.decomposition(c)
        if way.startswith(("<wide>", "<narrow>", "<font>")) or any(lo <= o <= hi for lo, hi in LIKE_PARTS):
            found.join(apart(c), apart("".join(chr(int(x, 16)) for x in way.split()[1:])))
    for own, alike in SAME_SHAPE:
        for x, y in zip(own, alike, strict=True):
            found.join(apart(x), apart(y))
    for x, y in SAME_STRING:
        found.join(apart(x), apart(y))
    for c in BLANK:
        found.join(" ", c)
    return found


def representatives(classes: Classes, counts: dict[str, int]) -> dict[str, str]:
    """Each string of a class to its representative, but for representatives themselves.

    ``counts`` are those of stored code points; what they are made of counts.
    """
    parts: dict[str, int] = {}
    for c, n in counts.items():
        for x in apart(c):
            parts[x] = parts.get(x, 0) + n
    groups: dict[str, list[str]] = {}
    for s in classes.up:
        groups.setdefault(classes.root(s), []).append(s)
    out = {}
    for members in groups.values():
        rep = " " if " " in members else min(members, key=lambda m: (-min(parts.get(c, 0) for c in m), len(m), m))
        out.update((m, rep) for m in members if m != rep)
    return out


def hidden_code_points() -> list[str]:
    return [chr(o) for o in range(sys.maxunicode + 1) if not 0xD800 <= o < 0xE000 and hidden(chr(o))]


class Rewriter(dict):
    """Greedy leftmost-longest rewriting until nothing changes; as a dict, the form of each word met."""

    def __init__(self, rules: dict[str, str], unseen: list[str]) -> None:
        super().__init__()
        table = ahocorasick.Automaton()
        for a, b in rules.items():
            table.add_word(a, (len(a), b))
        for c in unseen:
            table.add_word(c, (1, ""))
        table.make_automaton()
        self.table = table
        controls = "".join(c for c in (*unseen, *rules) if c.isascii() and len(c) == 1 and not c.isprintable())
        self.controls = re.compile(f"[{re.escape(controls)}]") if controls else None
        # whether printable ASCII can change at all
        self.plain = not any(a.isascii() and a.isprintable() for a in rules)

    def once(self, text: str) -> str:
        out, at = [], 0
        for last, (n, new) in self.table.iter_long(text):
            out.append(text[at : last + 1 - n])
            out.append(new)
            at = last + 1
        if not at:
            return text
        out.append(text[at:])
        return "".join(out)

    def settle(self, text: str) -> str:
        """Rewritten until it stays; should rewriting ever go in a circle, its least member."""
        met = []
        while True:
            text = apart(text)
            if text in met:
                return unicodedata.normalize("NFC", min(met[met.index(text) :]))
            met.append(text)
            text = self.once(text)
            if text == met[-1]:
                return unicodedata.normalize("NFC", text)

    def __missing__(self, word: str) -> str:
        form = self.settle(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = form
        return form

    def __call__(self, text: str) -> str:
        text = BREAKS.sub("\n", text)
        if self.controls is not None and self.controls.search(text):
            text = self.controls.sub(lambda m: self[m.group()], text)
        out = []
        for line in text.split("\n"):
            if not (self.plain and line.isascii()):
                line = " ".join([w if w.isascii() and self.plain else self[w] for w in line.split(" ")])
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                line = " ".join([w for w in line.split(" ") if w])
            out.append(line)
        return "\n".join(out)


def count_code_points(documents: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Occurrences of every code point in the corpus; at most one entry per code point of Unicode."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                texts = [t for t in batch.column(0).slice(lo, 500).to_pylist() if t]
                codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                part = np.bincount(codes)
                total[: len(part)] += part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["c", "n"])

    rows = documents.select(F.col(text_col).alias("text")).mapInArrow(tally, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return {chr(r.c): r.n for r in rows.collect()}


def one_form(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, text_key, form_key, n_visible) of every row with a text.

    ``form`` is the text in one consistent form, composed canonically, with
    single blanks; the keys are 128-bit hashes of stored text and form. Null
    texts give no row, empty ones an empty form. Repeated rows and texts of any
    length are rewritten each and whole; other columns are not read. Code
    points of all texts are counted.
    """
    rules = representatives(build_classes(), ascii_first(count_code_points(documents, text_col)))
    shared = documents.sparkSession.sparkContext.broadcast((rules, hidden_code_points()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(*shared.value)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = rewrite(text)
                row = (i, form, xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")), xxhash.xxh3_128_hexdigest(form.strip("\n").encode("utf-8", "surrogatepass")), len(form) - form.count(" ") - form.count("\n"))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "form", "text_key", "form_key", "n_visible"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    return rows.mapInArrow(run, "doc_id bigint, form string, text_key string, form_key string, n_visible int")


def ascii_first(counts: dict[str, int]) -> dict[str, int]:
    """Counts as they are; a missing ASCII letter counts once, so ties fall to it."""
    return {chr(c): 1 for c in range(32, 127)} | counts


def text_classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of) of every row with a text: the lowest doc_id with its form, and with its very text.

    Both are found by aggregation before anything joins, so a class of any size
    shuffles as one row a task.
    """
    keys = materialize(one_form(documents, id_col=id_col, text_col=text_col).select("doc_id", "text_key", "form_key"), "forms")
    by_text = keys.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("copy_of"))
    by_form = by_text.groupBy("form_key").agg(F.min("copy_of").alias("class_id"))
    return keys.join(by_text.join(by_form, "form_key"), ["form_key", "text_key"]).select("doc_id", "class_id", "copy_of")


def same_looking(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_visible: int = 40, expand: int = 64) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: stored texts that differ and have one form.

    Texts with fewer than ``least_visible`` visible characters are left out;
    equal stored texts are no pair. Of more than ``expand`` copies of one text
    only the lowest id is paired with other texts (``text_classes`` has the
    rest as its copies), so output grows with the rows and no link between two
    texts is lost. Only keys shuffle, never texts; copies are counted before
    they join, and only forms that two different texts share reach the join.
    """
    keys = one_form(documents, id_col=id_col, text_col=text_col).where(F.col("n_visible") >= least_visible).select("doc_id", "text_key", "form_key")
    keys = materialize(keys, "forms")
    by_text = keys.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    shared = by_text.groupBy("form_key").agg(F.count("*").alias("n")).where("n > 1").select("form_key")
    texts = materialize(by_text.join(shared, "form_key"), "texts")
    kept = keys.join(texts, ["form_key", "text_key"]).where((F.col("copies") <= expand) | (F.col("doc_id") == F.col("first")))
    a = kept.select("form_key", F.col("doc_id").alias("doc_id_a"), F.col("text_key").alias("ta"))
    b = kept.select("form_key", F.col("doc_id").alias("doc_id_b"), F.col("text_key").alias("tb"))
    return a.join(b, "form_key").where("doc_id_a < doc_id_b and ta <> tb").select("doc_id_a", "doc_id_b")
