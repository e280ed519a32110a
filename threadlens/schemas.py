"""Table schemas and the check made where a table enters the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

POSTS = _table(
    id=_S, title=_S, url=_S, subreddit=_S, author=_S, score=_L, num_comments=_L,
    created_utc=T.TimestampType(), selftext=_S,
)
COMMENTS = _table(
    id=_S, link_id=_S, parent_id=_S, body=_S, author=_S, subreddit=_S, score=_L,
    created_utc=T.TimestampType(),
)
EPIDEMIOLOGY = _table(date=T.DateType(), new_confirmed=_L, new_deceased=_L)
VACCINATIONS = _table(
    date=T.DateType(), new_persons_vaccinated=_L, new_persons_fully_vaccinated=_L,
    new_vaccine_doses_administered=_L,
)
LEXICON = _table(word=_S, valence=_D)
LEMMAS = _table(form=_S, lemma=_S)
ARTICLE_LABELS = _table(id=_S, true_count=_L, label=_S, title=_S, topic=_S)

# Result tables that are read back as inputs.
TOP_SOURCES = _table(source=_S, frequency=_L, total_score=_L)
TOP_SOURCES_BY_COMMUNITY = _table(source=_S, subreddit=_S, frequency=_L, total_score=_L, rank=_I)
TOP_AUTHORS = _table(author=_S, submission_count=_L)
YEAR_COUNTS = _table(year=_I, count=_L)
DAY_COUNTS = _table(day=_I, count=_L)
MISINFO_COUNTS = _table(misinfo_class=T.BooleanType(), count=_L)
SUMMARY = _table(summary=_S, score=_S)
TOPIC_COUNTS = _table(topic=_S, count=_L)
WEEK_COUNTS = _table(year_week=_S, count=_L)
MONTH_COUNTS = _table(year_month=_S, count=_L)
LABEL_COUNTS = _table(label=_S, count=_L)


def validate(df: DataFrame, schema: T.StructType, exact_types: bool = True) -> DataFrame:
    """Return ``df`` if it holds every column of ``schema``; otherwise raise, naming the columns.

    Both timestamp kinds count as equal: calendar functions treat them alike in a UTC session.
    """
    stamps = (T.TimestampType(), T.TimestampNTZType())
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    wrong = [
        f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in schema.fields
        if f.name in have and have[f.name] != f.dataType
        and not (f.dataType in stamps and have[f.name] in stamps)
    ]
    if missing or (exact_types and wrong):
        raise ValueError(f"missing columns {missing}; wrong types {wrong}")
    return df
