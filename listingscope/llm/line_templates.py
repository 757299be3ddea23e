"""Lines that recur across documents, found as templates of a fixed-depth tree; DataFrame functions only.

A line is its tokens, with every token that holds a digit replaced by ``<*>``. The tree has two fixed levels: the number of tokens, then the
first DEPTH tokens. In a leaf, the distinct lines vote on every further position, each with the number of documents it occurs in; a token with
more than half of the votes stays, any other position is a variable field ``<*>``. If at least SIMILAR of all positions stay, the result is the
leaf's template, and the lines that agree with it at every kept position are its instances; all other lines stand for themselves. A template
is dropped from all documents if enough documents with different texts hold it: two for a passage of 20 tokens and more, which nobody writes twice by
chance, up to MIN_DOCUMENTS for a heading of a few (ASKED). The number depends on the line alone, not on the data. Whole copies of a document count
once, so copying a document does not empty it.

Votes are sums that are added up before the shuffle, so a leaf that a third of all rows share does not gather in one task; the occurrences of one
line meet where its text is looked up, as narrow rows, and a skewed join splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.llm.columns import plain
from listingscope.session import cut

DEPTH, SIMILAR, MIN_DOCUMENTS = 3, 80, 10
ASKED = ((20, 2), (10, 4), (5, 7))   # tokens of a line and documents that must hold it; MIN_DOCUMENTS for shorter ones
FIELD = "<*>"
_BLANK = "[ \\t\\x0B\\f\\r]+"
_ODD_BLANKS = ("  ", "\t", "\x0b", "\f", "\r")
_DIGITS = "(?<![^ ])[^ 0-9]*[0-9][^ ]*"   # from the start of a token, so every character is looked at once


def _masked(line: Column) -> Column:
    """Tokens joined by one blank, those with a digit as FIELD."""
    odd = F.lit(False)
    for blank in _ODD_BLANKS:      # plain searches: most lines need no regular expression here
        odd = odd | line.contains(blank)
    even = F.when(odd, F.regexp_replace(line, _BLANK, " ")).otherwise(line)
    return F.trim(F.when(even.rlike("[0-9]"), F.regexp_replace(even, _DIGITS, FIELD)).otherwise(even))


def _asked(n: Column, min_documents: int) -> Column:
    """Documents asked for a line of n tokens, never more than ``min_documents``."""
    (tokens, documents), *rest = ASKED
    out = F.when(n >= tokens, min(documents, min_documents))
    for tokens, documents in rest:
        out = out.when(n >= tokens, min(documents, min_documents))
    return out.otherwise(min_documents)


def _lines(docs: DataFrame) -> DataFrame:
    """(id, t, pos, line, n, leaf, form): a row per line that has a token; leaf and form are hashes."""
    each = docs.select("id", "t", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("id", "t", "pos", _masked(F.col("raw")).alias("line"))
    each = each.where("line <> ''")
    blanks = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    return each.withColumn("n", blanks + 1).withColumn(
        "leaf", F.xxhash64("n", F.substring_index("line", " ", DEPTH))).withColumn("form", F.xxhash64("line"))


def recurring_forms(docs: DataFrame, min_documents: int, similar: int) -> tuple[DataFrame, DataFrame]:
    """(form) of all lines to drop, and the lines (id, t, pos, form) of docs (id, t, text)."""
    lines = cut(_lines(docs))   # masked once; each use below reads the columns it needs
    enough = F.col("docs") >= _asked(F.col("n"), min_documents)
    held = lines.select("n", "leaf", "form", "t").distinct()
    forms = cut(held.groupBy("n", "leaf", "form").agg(F.count(F.lit(1)).alias("docs")))
    leaves = forms.groupBy("leaf", "n").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("forms"))
    # A leaf with fewer documents than asked for, or with one line only, has no template to find.
    leaves = leaves.where(enough & (F.col("forms") > 1)).select("leaf")
    voters = forms.where(F.col("n") > DEPTH).join(leaves, "leaf").select("form", "leaf", "n", "docs")
    spelled = lines.select("form", "line").join(voters, "form").groupBy("form", "leaf", "n", "docs").agg(F.first("line").alias("line"))
    spelled = cut(spelled.withColumn("tokens", F.split("line", " ")).drop("line"))
    votes = spelled.select("leaf", "n", "docs", F.posexplode("tokens").alias("p", "token")).groupBy("leaf", "n", "p", "token").agg(F.sum("docs").alias("v"))
    places = votes.groupBy("leaf", "n", "p").agg(F.max_by("token", "v").alias("token"), (F.max("v") * 2 > F.sum("v")).alias("stays"))
    template = places.groupBy("leaf", "n").agg(
        F.sum((F.col("stays") & (F.col("token") != FIELD)).cast("int")).alias("kept"),
        F.transform(F.array_sort(F.collect_list(F.struct("p", F.when(F.col("stays"), F.col("token")).otherwise(FIELD).alias("token")))),
                    lambda x: x["token"]).alias("template"))
    template = template.where(F.col("kept") * 100 >= F.col("n") * similar).select("leaf", "template")
    agrees = F.forall(F.zip_with("tokens", "template", lambda a, b: (b == FIELD) | (a == b)), lambda x: x)
    instances = cut(spelled.join(template, "leaf").where(agrees).select("form", "leaf", "n"))
    # Documents of a template are counted anew: one document may hold several of its lines.
    spread = lines.select("form", "t").distinct().join(instances, "form").select("leaf", "n", "t").distinct().groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("docs"))
    by_template = instances.join(spread.where(enough).select("leaf"), "leaf").select("form")
    alone = forms.join(instances.select("form"), "form", "left_anti").where(enough).select("form")
    return by_template.unionByName(alone), lines


def drop_recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, similar: int = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns and rows of docs with ``text`` less its recurring lines, n_lines and n_dropped.

    A null text stays null with 0 lines; an empty one has one line, which is blank; blank lines are never dropped. Rows are told apart by key and
    text, so equal rows get equal results, and a null key is a key. Columns named n_lines or n_dropped are replaced; a column n_chars is kept as it
    is. An empty table gives an empty table.
    """
    docs, names, at = plain(docs, ("n_lines", "n_dropped"))
    key, text = at[key], at[text]
    mark = F.xxhash64(text)
    slim = docs.select(F.col(key).alias("id"), mark.alias("t"), F.col(text).alias("text")).where("text is not null")
    dropped, lines = recurring_forms(slim, min_documents, similar)
    gone = lines.select("id", "t", "pos", "form").join(dropped, "form").groupBy(F.col("id").alias("_id"), F.col("t").alias("_u")).agg(
        F.collect_set("pos").alias("_gone"))
    rows = docs.withColumn("_t", mark)
    rows = rows.join(gone, rows[key].eqNullSafe(gone["_id"]) & (rows["_t"] == gone["_u"]), "left")
    parts = F.split(F.col(text), "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return rows.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("bigint")).withColumn(
        "n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint")).withColumn(
        "n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("bigint")).withColumn(
        "n_dropped", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.col("n_dropped")).cast("bigint")).withColumn(
        text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)).select(*docs.columns, "n_lines", "n_dropped").toDF(*names, "n_lines", "n_dropped")


def recurring_lines_sql(min_documents: int = MIN_DOCUMENTS, similar: int = SIMILAR) -> str:
    """(doc_id, n_lines, n_dropped, kept_sha256) in DuckDB."""
    steps = " ".join(f"WHEN n >= {tokens} THEN {min(documents, min_documents)}" for tokens, documents in ASKED)
    asked = f"CASE {steps} ELSE {min_documents} END"
    return f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
split AS (SELECT doc_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM raw WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, text, pos, trim(regexp_replace(regexp_replace(part, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), '[^ \\t\\x0B\\f\\r]*[0-9][^ \\t\\x0B\\f\\r]*', '{FIELD}', 'g')) AS line
  FROM split),
toks AS (SELECT *, string_split(line, ' ') AS tokens FROM lines WHERE line <> ''),
forms AS (SELECT line, any_value(tokens) AS tokens, len(any_value(tokens)) AS n, array_to_string(any_value(tokens)[1:{DEPTH}], ' ') AS lead, count(DISTINCT text) AS docs FROM toks GROUP BY line),
leaves AS (SELECT n, lead FROM forms GROUP BY n, lead HAVING sum(docs) >= {asked} AND count(*) > 1),
voters AS (SELECT * FROM forms JOIN leaves USING (n, lead) WHERE n > {DEPTH}),
votes AS (SELECT n, lead, p, token, sum(docs) AS v FROM (SELECT n, lead, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM voters) GROUP BY ALL),
places AS (SELECT n, lead, p, CASE WHEN max(v) * 2 > sum(v) THEN max_by(token, v) ELSE '{FIELD}' END AS token FROM votes GROUP BY n, lead, p),
templates AS (
  SELECT n, lead, list(token ORDER BY p) AS template FROM places GROUP BY n, lead HAVING count(*) FILTER (WHERE token <> '{FIELD}') * 100 >= n * {similar}),
instances AS (
  SELECT line, n, lead FROM voters JOIN templates USING (n, lead)
  WHERE len(list_filter(list_zip(tokens, template), lambda x: x[2] <> '{FIELD}' AND x[1] <> x[2])) = 0),
spread AS (SELECT n, lead FROM instances JOIN toks USING (line) GROUP BY n, lead HAVING count(DISTINCT text) >= {asked}),
dropped AS (
  SELECT line FROM instances JOIN spread USING (n, lead)
  UNION ALL SELECT line FROM forms WHERE docs >= {asked} AND line NOT IN (SELECT line FROM instances)),
gone AS (SELECT DISTINCT doc_id, text, pos FROM toks JOIN dropped USING (line)),
kept AS (
  SELECT s.doc_id, s.text, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_dropped, coalesce(string_agg(s.part, chr(10) ORDER BY s.pos) FILTER (WHERE g.pos IS NULL), '') AS rest
  FROM (SELECT DISTINCT * FROM split) s LEFT JOIN gone g ON s.doc_id IS NOT DISTINCT FROM g.doc_id AND s.text = g.text AND s.pos = g.pos GROUP BY s.doc_id, s.text)
SELECT r.doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(rest) AS kept_sha256
FROM raw r LEFT JOIN kept k ON r.doc_id IS NOT DISTINCT FROM k.doc_id AND r.text = k.text"""
