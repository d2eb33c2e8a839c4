"""License scans by canonical digest: entire texts against known licences, with DataFrame functions alone.

A text is made canonical (lower case; runs of letters and digits joined by one space; copyright notices dropped;
equivalent spellings made one) and its SHA-256 is joined to those of the known licences. All of that reads words alone,
so wrapping a text anew, or putting it on one line, changes nothing. A notice runs from a copyright word with a sign or
year, or "all rights reserved", up to one of the `openings` with which a licence goes on, at most NOTICE_WORDS words
from the last such mark, or NAME_WORDS from the bare word; what isn't followed by an opening stays.
Only texts of a length that some licence has can match, so longer and shorter ones aren't digested.

The known licences are a small table of texts (the package's own, or the caller's); its size is counted, and beyond
BROADCAST_LICENCES it is joined by shuffle. Digests of licences are distinct keys, so a frequent licence splits no
join: the digest column of the documents may be skewed, the licence side is broadcast.

Null and empty texts match nothing. Rows that repeat are matched each. If two licences are the same canonical text,
the smaller name counts.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.shared import spread

BROADCAST_LICENCES = 10_000

# Spellings that count as one, after the published matching guidelines for licence texts.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("noncommercial", "non commercial"),
    ("copyright holder", "copyright owner"),
    ("sublicence", "sublicense"),
)
# Words with which a licence goes on after its notices.
OPENINGS = (
    "permission is hereby granted",
    "permission to use copy",
    "redistribution and use in",
    "this software is provided",
    "everyone is permitted to",
    "this program is free",
    "this library is free",
    "this is free and",
    "permission is granted to copy",
    "licensed under the",
)
NOTICE_WORDS, NAME_WORDS = 40, 8
SIGN, NOT_WORD = "©", r"[^\p{L}\p{N}]+"


def _notice(openings: tuple[str, ...]) -> str:
    """A pattern of one or more notices, with the opening after them as its group; words are parted by one space."""
    mark = r" (?:copyright (?:c|year|(?:19|20)\d\d)|c (?:19|20)\d\d|all rights reserved)"
    return rf"(?:{mark}\b(?: [^ ]+){{0,{NOTICE_WORDS}}}?| copyright(?: [^ ]+){{0,{NAME_WORDS}}}?)+? ({'|'.join(openings)})\b"


def _plain(text: Column, openings: tuple[str, ...]) -> Column:
    """Words joined and edged by one space, before spellings, without notices."""
    lower = F.replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(SIGN), F.lit(" copyright c "))
    plain = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), NOT_WORD, " ")
    return F.regexp_replace(plain, _notice(openings), " $1")


def _digests(rows: DataFrame, text: str, openings: tuple[str, ...], where: Column | None = None) -> DataFrame:
    """With the canonical text before spellings, __plain, and the digest of those rows for which `where` holds."""
    rows = rows.withColumn("__plain", _plain(F.col(text), openings))
    digest = F.sha2(_spelled(F.col("__plain")).cast("binary"), 256)
    return rows.withColumn("__digest", digest if where is None else F.when(where, digest))


def _spelled(plain: Column) -> Column:
    for other, usual in SPELLINGS:
        for _ in range(2):  # neighbours share the space between them
            plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {usual} "))
    return plain


def known_licences() -> list[tuple[str, str]]:
    """(name, text) of the licences that come with the package."""
    folder = resources.files("tephra.llm") / "licences"
    return sorted((f.name.removesuffix(".txt"), f.read_text()) for f in folder.iterdir() if f.name.endswith(".txt"))


def _known_frame(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(from_json(:t, 'array<struct<licence:string,text:string>>')) AS x", args={"t": _json()}).select("x.*")


def _json() -> str:
    import json

    return json.dumps([{"licence": n, "text": t} for n, t in known_licences()])


def licence_digests(docs: DataFrame, licences: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", openings: tuple[str, ...] = OPENINGS) -> DataFrame:
    """(doc_id, licence, digest) of every row of `docs`; NULL where it is no known licence. licences: (licence, text).

    openings: words in lower case, parted by one space, with which the licences go on after a notice.
    """
    known = licences if licences is not None else _known_frame(docs.sparkSession)
    known = _digests(known.select(F.col("licence").alias("__licence"), F.col("text").alias("__text")), "__text", openings).where(F.length(F.trim("__plain")) > 0)
    size = F.length("__plain")
    bounds = known.agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.count("*").alias("n")).first()  # one row
    near = size.between((bounds["lo"] or 0) // 2, (bounds["hi"] or 0) * 2)  # a spelling changes a word's length by less than a half
    own = _digests(spread(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text")), "__text", openings, near).select("doc_id", "__digest")
    side = known.groupBy("__digest").agg(F.min("__licence").alias("licence"))
    own = own.join(F.broadcast(side) if bounds["n"] <= BROADCAST_LICENCES else side, "__digest", "left")
    return own.select("doc_id", "licence", F.when(F.col("licence").isNotNull(), F.col("__digest")).alias("digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    def plain(t: str) -> str:
        words = f"regexp_replace(' ' || replace(lower(coalesce({t}, '')), '{SIGN}', ' copyright c ') || ' ', '{NOT_WORD}', ' ', 'g')"
        return f"regexp_replace({words}, '{_notice(OPENINGS)}', ' \\1', 'g')"

    def spelled(x: str) -> str:
        for other, usual in SPELLINGS:
            for _ in range(2):
                x = f"replace({x}, ' {other} ', ' {usual} ')"
        return x

    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known_licences())
    return f"""
WITH k AS (SELECT min(licence) AS licence, sha256({spelled("p")}) AS digest FROM (SELECT licence, {plain("t")} AS p FROM (VALUES {values}) v(licence, t)) GROUP BY 2),
d AS (SELECT doc_id, sha256({spelled("p")}) AS digest FROM (SELECT doc_id, {plain("text")} AS p FROM documents))
SELECT d.doc_id, k.licence, k.digest FROM d LEFT JOIN k USING (digest)
"""


ORACLE = _sql()
