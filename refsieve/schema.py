"""Schemas of the snapshot record, the result table and the smaller input tables."""

from pyspark.sql import types as T

REFERENCE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("unstructured", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("DOI", T.StringType()),
    ]
)

NAME = T.StructType(
    [T.StructField("family", T.StringType()), T.StructField("given", T.StringType())]
)

TYPED_ISSN = T.StructType(
    [T.StructField("value", T.StringType()), T.StructField("type", T.StringType())]
)

DATE_PARTS = T.StructType([T.StructField("date-parts", T.ArrayType(T.ArrayType(T.IntegerType())))])

WORK = T.StructType(
    [
        T.StructField("DOI", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.ArrayType(T.StringType())),
        T.StructField("author", T.ArrayType(NAME)),
        T.StructField("container-title", T.ArrayType(T.StringType())),
        T.StructField("issn-type", T.ArrayType(TYPED_ISSN)),
        T.StructField("member", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("reference-count", T.IntegerType()),
        T.StructField("is-referenced-by-count", T.IntegerType()),
        T.StructField("deposited", DATE_PARTS),
        T.StructField("published", DATE_PARTS),
        T.StructField("reference", T.ArrayType(REFERENCE)),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("DOI", T.StringType(), False),
        T.StructField("token_vocabulary", T.ArrayType(T.StringType())),
        T.StructField("token_frac_refs", T.FloatType()),
        T.StructField("total_processed_ref_len", T.IntegerType()),
        T.StructField("cleaned_references_length", T.IntegerType()),
        T.StructField("total_reference_length", T.IntegerType(), False),
        T.StructField("work_type", T.StringType()),
        T.StructField("author", T.ArrayType(T.StringType())),
        T.StructField("flag", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("issn", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("title", T.StringType()),
        T.StructField("container_title", T.ArrayType(T.StringType())),
    ]
)

JOURNALS = T.StructType(
    [
        T.StructField("issn", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("total_dois", T.LongType()),
    ]
)

IGNORE_TOKENS = T.StructType([T.StructField("unwanted_tokens", T.ArrayType(T.StringType()))])
IGNORE_COUNTRIES = T.StructType([T.StructField("countries", T.ArrayType(T.StringType()))])
