"""Spelling variants: one-edit neighbourhoods of words in a reduced alphabet, joined and verified on the words themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import written

#: The letters of words, and those that are lower-cased.
LETTERS, CAPITALS = r"[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHORTEST, SEEN, TIMES, SPOIL = 6, 5, 5, 199
#: Symbols of the reduced alphabet for reduced words below a length: short words are many to a class, so they keep more.
FEW = ((8, 12), (10, 6), (None, 4))
MAX_ROUNDS = 8


def spoiled(doc_id: Column, word: Column) -> Column:
    """The word without one code point where the checksum of `doc_id:word` divides by SPOIL; a null doc_id changes nothing."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % SPOIL == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def counted(docs: DataFrame, spoil: bool = False) -> DataFrame:
    """word, n of every text's words; tasks count before the shuffle."""
    lower = F.translate(F.col("text").cast("string"), CAPITALS, CAPITALS.lower())
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("word"))
    if spoil:
        words = words.select(F.coalesce(spoiled(F.col("doc_id"), F.col("word")), F.col("word")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs: DataFrame, spoil: bool = False) -> DataFrame:
    """word, n of the words with at least SHORTEST code points and SEEN occurrences."""
    return counted(docs, spoil).where((F.length("word") >= SHORTEST) & (F.col("n") >= SEEN))


def _alphabet(few: int) -> tuple[str, str]:
    """The letters and the symbol of each: code points times a fixed odd number, the upper bits of it."""
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    return "".join(letters), "".join(chr(0x61 + ((ord(c) * 2654435761 & 0xFFFFFFFF) * few >> 32)) for c in letters)


def _by_length(length: Column, of) -> Column:
    """of(few) with the number of symbols for that length."""
    out = of(FEW[-1][1])
    for below, few in reversed(FEW[:-1]):
        out = F.when(length < below, of(few)).otherwise(out)
    return out


def reduced(word: Column, length: Column) -> Column:
    """The word with its letters hashed to few symbols; how many depends on the length that the reduced word is compared at."""
    return _by_length(length, lambda few: F.translate(word, *_alphabet(few)))


def _symbols(length: Column) -> Column:
    return _by_length(length, lambda few: F.array(*(F.lit(chr(0x61 + i)) for i in range(few))))


def neighbourhood(word: Column) -> Column:
    """Every string that is the reduced word, or one replaced or deleted symbol away from it, in the alphabet of its own length.

    A word is near a longer one if that one has it among its deletions, so insertions need not be made a second time; of two
    words of one length the one whose reduced form is greater in code points makes the other's.
    """
    n = F.length(word)
    same, shorter = F.col("_same"), F.col("_shorter")
    places = F.sequence(F.lit(1), n)
    without = F.transform(places, lambda i: F.concat(F.substring(shorter, F.lit(1), i - 1), F.substring(shorter, i + 1, n)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(F.col("_symbols"), lambda s: s < F.substring(same, i, F.lit(1))),
        lambda s: F.concat(F.substring(same, F.lit(1), i - 1), s, F.substring(same, i + 1, n)))))
    return F.array_distinct(F.concat(F.array(same), replaced, without))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words (word, n; no word twice) that are one edit apart.

    Candidates share a reduced string; the edit distance of the words themselves decides.
    """
    n = F.length("word")
    spelled = words.withColumns({"_same": reduced(F.col("word"), n), "_shorter": reduced(F.col("word"), n - 1), "_symbols": _symbols(n)})
    made = spelled.select("word", "n", F.posexplode(neighbourhood(F.col("word"))).alias("at", "key"))
    held = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), reduced(F.col("word"), n).alias("key"))
    # Words of one reduced form (the first of the neighbourhood) meet from both sides, others from one.
    once = (F.col("at") > 0) | (F.col("word") < F.col("near"))
    pairs = made.join(held, "key").where(once & (F.levenshtein("word", "near", 1) == 1))
    side = lambda x, y: F.struct(F.col(x[0]).alias("word"), F.col(x[1]).alias("n"), F.col(y[0]).alias("near"), F.col(y[1]).alias("near_n"))
    one, other = ("word", "n"), ("near", "near_n")
    return pairs.select(F.inline(F.array(side(one, other), side(other, one))))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: the last word that forms lead to, the word itself if it has none.

    Each round doubles how far a word sees; a form is TIMES as frequent as its word, so chains are short and end.
    """
    known = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        far = known.where("word <> root").alias("k").join(known.where("word <> root").select(F.col("word").alias("_w"), F.col("root").alias("_r")), F.col("k.root") == F.col("_w"), "left")
        note = Observation()
        moved = written(far.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")).observe(note, F.count_if("moved").alias("n")), "roots")
        known = moved.select("word", "root")
        if not note.get.get("n"):
            break
    else:
        raise RuntimeError("roots did not settle")
    return forms.join(known, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(words: DataFrame) -> DataFrame:
    """word, n, form, root, n_near, form_n of a vocabulary (word, n): each word's near word of largest n, if that is TIMES its own or more."""
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b"))
    joined = words.join(best, "word", "left")
    fits = -F.col("b.m") >= TIMES * F.col("n")
    forms = joined.select("word", "n", F.when(fits, F.col("b.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("b.m")).alias("form_n"))
    return with_roots(written(forms, "forms"))


def spelling_variants(docs: DataFrame, spoil: bool = False) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, of at least SHORTEST code points and
    SEEN occurrences (n). near: one code point inserted, deleted or replaced. form: the near word of largest n (ties: first
    in code-point order) if its n is TIMES the word's or more; root: the last word that forms lead to. Null, empty and
    letterless texts have no words; repeated rows count each; an empty table gives no row; other columns are ignored.

    spoil: delete a code point of about one word in 199 first (see `spoiled`).
    """
    return grouped(written(vocabulary(docs, spoil), "vocabulary")).select("word", "form", "root", "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs, spoil=True)


#: The same rows: checksums by the table of the 256 byte values, all pairs that share a word with one code point left out.
ORACLE_SQL = """
WITH RECURSIVE
table_of AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
per AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, w, n, list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1) AS b FROM per),
crc AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, table_of),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc) GROUP BY word
  HAVING sum(n) >= 5 AND length(word) >= 6),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(near) FILTER (m = top) AS near, any_value(top) AS m FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
