"""Deterministic near-duplicates of texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYNONYMS = {"big": "large", "fast": "quick", "error": "fault", "server": "host", "user": "client", "begin": "start", "end": "finish", "help": "assist"}
FILLERS = ("really", "also", "now", "then")


def _draw(text: Column, seed: int, salt: str, below: Column) -> Column:
    """A number from 0 that depends on the text, the seed and a salt alone: 60 bits of a digest, modulo ``below``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), text))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.greatest(below, F.lit(1))).cast("int")


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once, however often and deep within it is named."""
    return F.get(F.transform(F.array(value), lambda bound: fn(bound)), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def swap_words(text: Column, seed: int = 0) -> Column:
    """Two neighbouring words change places; shorter texts stay."""

    def swapped(w: Column, i: Column) -> Column:
        order = F.transform(w, lambda x, k: F.when(k == i, F.get(w, i + 1)).when(k == i + 1, F.get(w, i)).otherwise(x))
        return F.when(F.size(w) < 2, text).otherwise(F.array_join(order, " "))

    return _bind(_words(text), lambda w: _bind(_draw(text, seed, "swap", F.size(w) - 1), lambda i: swapped(w, i)))


def replace_synonyms(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.array_join(F.transform(_words(text), lambda x: F.coalesce(table[F.lower(x)], x)), " ")


def insert_word(text: Column, seed: int = 0) -> Column:
    filler = F.element_at(F.array(*map(F.lit, FILLERS)), _draw(text, seed, "word", F.lit(len(FILLERS))) + 1)
    return _bind(_words(text), lambda w: _bind(_draw(text, seed, "at", F.size(w) + 1), lambda i: F.array_join(F.array_insert(w, i + 1, filler), " ")))


def remove_word(text: Column, seed: int = 0) -> Column:
    """One word goes; a text of one word or none stays."""
    removed = lambda w, i: F.when(F.size(w) < 2, text).otherwise(F.array_join(F.filter(w, lambda x, k: k != i), " "))
    return _bind(_words(text), lambda w: _bind(_draw(text, seed, "drop", F.size(w)), lambda i: removed(w, i)))


def mutate(text: Column, seed: int = 0) -> Column:
    """One of the four mutations, chosen by the text and the seed."""
    return _bind(
        _draw(text, seed, "kind", F.lit(4)),
        lambda kind: F.when(kind == 0, swap_words(text, seed)).when(kind == 1, replace_synonyms(text)).when(kind == 2, insert_word(text, seed)).otherwise(remove_word(text, seed)),
    )


def draw_sql(text: str, seed: int, salt: str, below: str) -> str:
    """The same draw in DuckDB."""
    return f"(('0x' || substr(md5('{seed}:{salt}:' || {text}), 1, 15))::BIGINT % greatest({below}, 1))"


def mutate_sql(text: str, seed: int = 0) -> str:
    """The same mutation in DuckDB; ``text`` is a column."""
    w = rf"list_filter(string_split_regex({text}, '[ \t\n\r\f]+'), lambda x: x <> '')"
    n = f"len({w})"
    at = lambda salt, below: draw_sql(text, seed, salt, below)
    i = at("swap", f"{n} - 1")
    swap = f"CASE WHEN {n} < 2 THEN {text} ELSE array_to_string({w}[:{i}] || [{w}[{i} + 2], {w}[{i} + 1]] || {w}[{i} + 3:], ' ') END"
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SYNONYMS.items()) + "}"
    synonyms = f"array_to_string(list_transform({w}, lambda x: coalesce({table}[lower(x)], x)), ' ')"
    fillers = "[" + ", ".join(f"'{f}'" for f in FILLERS) + "]"
    j = at("at", f"{n} + 1")
    insert = f"array_to_string({w}[:{j}] || [{fillers}[{at('word', str(len(FILLERS)))} + 1]] || {w}[{j} + 1:], ' ')"
    k = at("drop", n)
    remove = f"CASE WHEN {n} < 2 THEN {text} ELSE array_to_string({w}[:{k}] || {w}[{k} + 2:], ' ') END"
    return f"CASE {at('kind', '4')} WHEN 0 THEN {swap} WHEN 1 THEN {synonyms} WHEN 2 THEN {insert} ELSE {remove} END"


def shuffle_words(text: Column, seed: int = 0) -> Column:
    """All words in the order of a seeded digest; equal words keep theirs."""
    w = F.transform(_words(text), lambda x, k: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"), x)).alias("d"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(w), lambda s: s["x"]), " ")


#: Share of words that a pair of each score band keeps.
BANDS = {"identical": 1.0, "near": 0.8, "related": 0.5, "weak": 0.2, "unrelated": 0.0}


def keep_words(text: Column, share: float, seed: int = 0) -> Column:
    """About that share of the words stay; the others become fillers with a number, which no other text has."""
    w = _words(text)
    draw = lambda x, k: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:keep:"), k.cast("string"), F.lit(":"), x)), 1, 12), 16, 10).cast("bigint"), F.lit(1000))
    return F.array_join(F.transform(w, lambda x, k: F.when(draw(x, k) < int(1000 * share), x).otherwise(F.concat(F.lit("q"), F.substring(F.md5(F.concat(x, F.lit(str(seed)))), 1, 7)))), " ")


def banded_pairs(df: DataFrame, key: str, text_col: str, seed: int = 0) -> DataFrame:
    """``original_id, band, text_a, text_b, share``: of each text one pair a score band, ``share`` being the words that stay."""
    bands = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(s).alias("share")) for n, s in BANDS.items()))).alias("b")
    rows = df.select(F.col(key).alias("original_id"), F.col(text_col).alias("text_a"), bands)
    made = F.lit(None).cast("string")
    for n, s in BANDS.items():
        made = F.when(F.col("b.band") == n, keep_words(F.col("text_a"), s, seed)).otherwise(made)
    return rows.select("original_id", "b.band", "text_a", made.alias("text_b"), "b.share")


def demo_lines() -> tuple[str, ...]:
    """Lines for a first try: copies, near copies and others."""
    base = "the server returned an error while the user was waiting for the page"
    return (base, base, "the server returned a fault while the user was waiting for the page", base.upper(), "quarterly revenue grew in every region", "revenue grew in every region this quarter", "a recipe for bread with four ingredients")


def perturb_character(text: Column, seed: int = 0) -> Column:
    """Two characters swap, or one is dropped or doubled."""
    n = F.length(text)
    i = _draw(text, seed, "char", n - 1) + 1
    kind = _draw(text, seed, "edit", F.lit(3))
    left, one, two = F.substr(text, F.lit(1), i - 1), F.substr(text, i, F.lit(1)), F.substr(text, i + 1, F.lit(1))
    rest, tail = F.substr(text, i + 1), F.substr(text, i + 2)
    edited = F.when(kind == 0, F.concat(left, two, one, tail)).when(kind == 1, F.concat(left, rest)).otherwise(F.concat(left, one, one, rest))
    return F.when(n < 2, text).otherwise(edited)


def near_duplicates(df: DataFrame, key: str, text_col: str, copies: int = 1) -> DataFrame:
    """``original_id, copy, text, mutated`` with ``copies`` mutations of every text."""
    rows = df.select(F.col(key).alias("original_id"), F.col(text_col).alias("text"))
    parts = [rows.select("original_id", F.lit(c).alias("copy"), "text", mutate(F.col("text"), c).alias("mutated")) for c in range(copies)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
