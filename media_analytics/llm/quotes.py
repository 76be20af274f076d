"""Chat formatting by quotation linking, DataFrame functions only.

* **Quote levels.** A line's level is the number of ``>`` it starts with (blanks
  allowed between them). A quoted passage is a run of lines of one level.
* **Hashes.** A passage is normalised (A-Z lower case, white space to one blank,
  trimmed) and hashed (64 bits): whole, by line, by paragraph (between blank lines, whatever its
  line breaks), by sentence of a paragraph and by each ``PHRASE`` successive words. So are the own
  (level 0) runs of lines of every message of a conversation with quotes. Re-wrapped
  quotes, one paragraph, one sentence and a part of a paragraph therefore find their
  origin; a part that is no line, sentence or paragraph needs ``PHRASE`` words.
* **Two steps.** Phrases are a row per word, the other parts a few per line. Only
  the runs that have no longer part linked than ``PHRASE`` words can gain by a phrase, so phrases
  (and parts of as many words, which may equal one) are made of these runs and of the
  conversations that hold one.
* **Links.** A quoted hash joins the first message of the same conversation that
  wrote it, if that has an earlier turn. First occurrences are found by a partial aggregate,
  so a passage quoted or repeated by a third of all rows meets one row. A
  message replies to the link of the lowest level, then of the most words, then of the latest turn.
* **Order.** The root of a message is found by pointer doubling over the links.
  A conversation is ordered by (root's turn, turn): threads stay together and
  every reply follows what it answers. Positions come from ``prefix_sums``, so a
  conversation with a third of all rows is not one task.

The result has a row per row of the table: text without quoted lines, and the
formatted message ``<|role|>`` newline text newline ``<|end|>``.

Nulls: a null text is empty; a null role is ``unknown``; messages with a null
conv_id or turn quote nothing and are their own roots, and nulls come last.
Identical rows are one message (they share a position) and stay repeated.
Messages that share a turn share its links. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_az, prefix_sums, table

QUOTE = r"^[ \t]*>[> \t]*"  # blanks and signs, no repeated group: any depth is matched
BREAK = r"\r\n|\r|\n"
SENTENCE = r"(?<=[.!?][\"')\]]{0,2}) |(?<=[\u3002\uff01\uff1f])"  # where the next one begins
PHRASE = 8  # words


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_az(text), r"[ \t\r\n\f\x0B]+", " "))


def own_text(text: Column) -> Column:
    """The text without its quoted lines and without blank lines at its ends."""
    kept = F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(QUOTE)), "\n")
    return F.regexp_replace(kept, r"^[ \t\n]+|[ \t\n]+$", "")


def _parts(lines: Column) -> Column:
    """(hash, words) of a run's normalised lines: whole, lines, paragraphs and
    sentences. Blank lines part paragraphs."""
    joined = F.array_join(lines, "\n")
    paragraphs = F.transform(F.split(joined, "\n{2,}"), lambda p: F.trim(F.translate(p, "\n", " ")))
    texts = F.concat(F.array(F.array_join(F.filter(lines, lambda x: x != ""), " ")), lines, paragraphs,
                     F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE))))
    texts = F.array_distinct(F.filter(texts, lambda x: x != ""))
    return F.transform(texts, lambda u: F.struct(F.xxhash64(u).alias("hash"), F.size(F.split(u, " ")).alias("words")))


def _phrases(lines: Column) -> Column:
    """Hashes of each ``PHRASE`` successive words of a run with more words."""
    # an array of one array: the words are bound once, not for each place
    words = F.array(F.split(F.array_join(F.filter(lines, lambda x: x != ""), " "), " "))
    return F.array_distinct(F.flatten(F.transform(words, lambda ws: F.when(
        F.size(ws) > PHRASE, F.transform(F.sequence(F.lit(1), F.size(ws) - PHRASE + 1),
                                         lambda i: F.xxhash64(F.array_join(F.slice(ws, i, PHRASE), " "))))
        .otherwise(F.array()))))


def runs(messages: DataFrame) -> DataFrame:
    """(key, conv_id, turn, level, run, lines): each run of lines of one level; key names a
    distinct message."""
    line = (messages.select("key", "conv_id", "turn", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
            .withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", QUOTE, 0), r"[^>]", "")))
            .withColumn("line", normalised(F.regexp_replace("line", QUOTE, ""))))
    # successive lines of one level have one difference of these numbers
    nth = F.row_number().over(Window.partitionBy("key", "level").orderBy("at"))
    line = line.withColumn("run", F.col("at") - nth)
    runs = (line.groupBy("key", "conv_id", "turn", "level", "run")
            .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"))
            .select("key", "conv_id", "turn", "level", "run", F.transform("parts", lambda p: p["line"]).alias("lines")))
    return runs.where(F.exists("lines", lambda x: x != ""))


def _best(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """(key, conv_id, turn, level, run, best): best is the (words, first turn) of the most words that
    an earlier message of the conversation wrote first; null if there is none. quoted and own:
    runs with the parts (hash, words) ``units``."""
    first = (own.select("conv_id", "turn", F.explode("units.hash").alias("hash"))
             .groupBy("conv_id", "hash").agg(F.min("turn").alias("first_turn")))
    asked = (quoted.select("key", "conv_id", "turn", "level", "run", F.explode("units").alias("u"))
             .select("key", "conv_id", "turn", "level", "run", "u.hash", "u.words"))
    linked = F.col("first_turn") < F.col("turn")
    return (asked.join(first, ["conv_id", "hash"], "left").groupBy("key", "conv_id", "turn", "level", "run")
            .agg(F.max(F.when(linked, F.struct("words", "first_turn"))).alias("best")))


def link(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, n_quoted, n_linked), (conv_id, turn, parent_turn)) of the rows' distinct messages.
    Texts are moved only of conversations with a quote."""
    usable = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    talks = usable.where(F.col("text").rlike("(?m)" + QUOTE)).select("conv_id").distinct()
    found = runs(cut(usable.join(talks, "conv_id", "left_semi").dropDuplicates(["key"])))
    own, quoted = found.where("level = 0"), found.where("level > 0")
    parts = F.filter(_parts(F.col("lines")), lambda u: u["words"] != PHRASE)
    parts = cut(_best(quoted.withColumn("units", parts), own.withColumn("units", parts)))
    # phrases only where they can win: no longer part is linked
    weak = parts.where(F.col("best").isNull() | (F.col("best.words") < PHRASE)).select("key", "level", "run")
    whole = F.transform(F.filter(_parts(F.col("lines")), lambda u: u["words"] == PHRASE), lambda u: u["hash"])
    phrases = F.transform(F.array_union(_phrases(F.col("lines")), whole),
                          lambda h: F.struct(h.alias("hash"), F.lit(PHRASE).alias("words")))
    asked = (quoted.join(weak, ["key", "level", "run"], "left_semi").withColumn("units", phrases)
             .where(F.size("units") > 0))
    held = own.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("units", phrases)
    more = _best(asked, held).select("key", "level", "run", F.col("best").alias("phrase"))
    per_run = cut(parts.join(more, ["key", "level", "run"], "left")
                  .withColumn("best", F.greatest("best", "phrase")).drop("phrase"))
    per_key = per_run.groupBy("key").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("best").alias("n_linked"))
    parents = (per_run.where("best is not null").groupBy("conv_id", "turn")
               .agg(F.max(F.struct((-F.col("level")).alias("near"), "best")).alias("b"))
               .select("conv_id", "turn", F.col("b.best.first_turn").alias("parent_turn")))
    return per_key, parents


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn) of the linked messages, by pointer doubling."""
    up = cut(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn")))
    while not up.isEmpty():
        above = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("r"))
        step = cut(up.join(above, (F.col("conv_id") == F.col("c")) & (F.col("root_turn") == F.col("t")), "left")
                   .select("conv_id", "turn", F.coalesce("r", "root_turn").alias("root_turn"),
                           F.col("r").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return up


def conversations(table_: DataFrame) -> DataFrame:
    """(conv_id, turn, role, position, parent_turn, root_turn, n_quoted, n_linked, text,
    formatted) per row."""
    rows = table_.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                         F.col("text").cast("string"))
    # null and empty differ; a length before each text keeps the parts apart
    part = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c)), F.lit("-"))
            for c in ("conv_id", "turn", "role", "text")]
    rows = rows.withColumn("key", F.md5(F.concat(*part)))
    per_key, parents = link(rows)
    messages = rows.select("key", "conv_id", "turn").dropDuplicates(["key"])
    parents = cut(parents)
    tree = parents.join(roots(parents), ["conv_id", "turn"], "left")
    placed = (messages.select("key", "conv_id", "turn").join(tree, ["conv_id", "turn"], "left")
              .join(per_key, "key", "left")
              .withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("one", F.lit(1)))
    # the sums are kept by key, so rows are matched to them by key alone
    order = prefix_sums(placed, ["conv_id"], ["root_turn", "turn", "key"], "one", "position")
    info = order.select("key", "position", "parent_turn", "root_turn",
                        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "n_linked")])
    return (rows.join(info, "key").withColumn("text", own_text(F.col("text")))
            .select("conv_id", "turn", "role", F.col("position").cast("long"), "parent_turn", "root_turn",
                    "n_quoted", "n_linked", "text",
                    F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"),
                             F.lit("\n<|end|>")).alias("formatted")))


def op7_chat_quotes(spark, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


_NORMAL = ("trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           "'[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))")

OP7_SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT conv_id, turn, role, text,
    md5(coalesce(length(conv_id::VARCHAR) || ':' || conv_id, '-') || coalesce(length(turn::VARCHAR) || ':' || turn, '-')
        || coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-')) AS key
  FROM conversations),
messages AS (SELECT DISTINCT * FROM rows_),
split_ AS (SELECT key, conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM messages),
lines AS (SELECT key, conv_id, turn, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM split_),
leveled AS (
  SELECT key, conv_id, turn, pos, line, line AS raw,
    length(regexp_replace(regexp_extract(line, '{QUOTE}'), '[^>]', '', 'g')) AS level FROM lines),
clean AS (
  SELECT key, conv_id, turn, pos, level, raw, {_NORMAL.format(f"regexp_replace(line, '{QUOTE}', '')")} AS line,
    pos - row_number() OVER (PARTITION BY key, level ORDER BY pos) AS run FROM leveled),
full_ AS (SELECT * FROM clean WHERE line <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
wholes AS (SELECT key, conv_id, turn, level, run, string_agg(line, ' ' ORDER BY pos) AS unit FROM full_ GROUP BY ALL),
paragraphs AS (
  SELECT key, conv_id, turn, level, run, trim(translate(unnest(regexp_split_to_array(joined, '\n{{2,}}')), chr(10), ' ')) AS unit
  FROM (SELECT key, conv_id, turn, level, run, string_agg(line, chr(10) ORDER BY pos) AS joined FROM clean
        WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)),
sentences AS (
  SELECT key, conv_id, turn, level, run, unnest(string_split(regexp_replace(regexp_replace(
    unit, '([.!?]["'')\]]{{0,2}}) ', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1))) AS unit FROM paragraphs),
words_ AS (SELECT key, conv_id, turn, level, run, string_split(unit, ' ') AS ws FROM wholes),
phrases AS (
  SELECT key, conv_id, turn, level, run, array_to_string(ws[i:i + {PHRASE - 1}], ' ') AS unit
  FROM (SELECT *, unnest(range(1, len(ws) - {PHRASE} + 2)) AS i FROM words_ WHERE len(ws) > {PHRASE})),
units AS (
  SELECT * FROM wholes UNION ALL SELECT key, conv_id, turn, level, run, line FROM full_
  UNION ALL SELECT * FROM paragraphs WHERE unit <> '' UNION ALL SELECT * FROM sentences WHERE unit <> ''
  UNION ALL SELECT * FROM phrases),
first_ AS (SELECT conv_id, unit, min(turn) AS first_turn FROM units WHERE level = 0 GROUP BY ALL),
hits AS (
  SELECT u.*, len(string_split(u.unit, ' ')) AS words, f.first_turn
  FROM units u LEFT JOIN first_ f ON u.conv_id = f.conv_id AND u.unit = f.unit WHERE u.level > 0),
per_run AS (
  SELECT key, conv_id, turn, level, run,
    max(CASE WHEN first_turn < turn THEN {{'w': words, 't': first_turn}} END) AS best FROM hits GROUP BY ALL),
per_key AS (SELECT key, count(*) AS n_quoted, count(best) AS n_linked FROM per_run GROUP BY key),
parents AS (
  SELECT conv_id, turn, max({{'near': -level, 'best': best}}).best.t AS parent_turn
  FROM per_run WHERE best IS NOT NULL GROUP BY ALL),
up AS (
  SELECT conv_id, turn, parent_turn AS pos FROM parents
  UNION ALL SELECT up.conv_id, up.turn, p.parent_turn FROM up JOIN parents p ON up.conv_id = p.conv_id AND up.pos = p.turn),
roots AS (SELECT conv_id, turn, min(pos) AS root_turn FROM up GROUP BY ALL),
placed AS (
  SELECT m.key, p.parent_turn, coalesce(r.root_turn, m.turn) AS root_turn,
    row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(r.root_turn, m.turn) NULLS LAST, m.turn NULLS LAST, m.key) - 1
      AS position
  FROM messages m LEFT JOIN parents p ON m.conv_id = p.conv_id AND m.turn = p.turn
  LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn),
own AS (
  SELECT key, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''),
                             '^[ \t\n]+|[ \t\n]+$', '', 'g') AS text
  FROM leveled GROUP BY key)
SELECT x.conv_id, x.turn, x.role, p.position, p.parent_turn, p.root_turn, coalesce(k.n_quoted, 0) AS n_quoted,
  coalesce(k.n_linked, 0) AS n_linked, o.text,
  '<|' || coalesce(x.role, 'unknown') || '|>' || chr(10) || o.text || chr(10) || '<|end|>' AS formatted
FROM rows_ x JOIN placed p ON x.key = p.key JOIN own o ON x.key = o.key LEFT JOIN per_key k ON x.key = k.key
"""
