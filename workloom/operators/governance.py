"""Catalog governance: PII classes, compliance tags, table documents, name audits, table usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workloom.functions import lexical as lx
from workloom.functions.names import is_system_table, reference_problem
from workloom.operators.rewrites import merge

# PII classes with the name parts that reveal them, in class order.
PII_CLASSES = (
    ("email", ("email", "e_mail", "mail_address")),
    ("phone", ("phone", "mobile", "telephone", "tel_number")),
    ("ssn", ("ssn", "national_insurance", "ni_number", "tax_id")),
    ("patient", ("patient_id", "patient_name", "medical_record", "mrn", "nhs_number")),
    ("name", ("first_name", "last_name", "full_name", "surname", "given_name")),
    ("address", ("address", "street", "postcode", "postal_code", "zip_code")),
    ("dob", ("date_of_birth", "dob", "birth_date", "birthdate")),
    ("financial", ("account_number", "sort_code", "iban", "card_number")),
    ("clinical", ("diagnosis", "medication", "treatment", "clinical_trial")),
    ("ip_address", ("ip_address", "ip_addr", "client_ip")),
)
# Compliance tag and the words in a table comment that call for it.
COMPLIANCE = (
    ("GDPR", ("gdpr", "personal data")), ("PCI-DSS", ("pci", "payment")),
    ("HIPAA", ("hipaa", "phi")), ("GxP", ("gxp", "21 cfr")),
)


def pii_classes(name: Column, comment: Column) -> Column:
    low_name, low_comment = F.lower(name), F.lower(F.coalesce(comment, F.lit("")))
    return F.array_compact(F.array(*[
        F.when(low_name.rlike("|".join(parts)) | low_comment.rlike("|".join(parts)), F.lit(cls))
        for cls, parts in PII_CLASSES
    ]))


def compliance_tags(comment: Column) -> Column:
    low = F.lower(F.coalesce(comment, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(tag)) for tag, words in COMPLIANCE]))


def classified(columns: DataFrame) -> DataFrame:
    return columns.withColumn("pii", pii_classes(F.col("column_name"), F.col("column_comment")))


def pii_summary(columns: DataFrame) -> DataFrame:
    """Sorted distinct indicators and compliance tags per table."""
    return classified(columns).groupBy("table_name").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pii")))).alias("pii_indicators"),
        F.max("table_comment").alias("table_comment"),
    ).withColumn("security_tags", compliance_tags(F.col("table_comment")))


def table_documents(columns: DataFrame, table_tags: DataFrame, column_tags: DataFrame) -> DataFrame:
    """One nested document per table. ``table_tags`` has (table_name, tags), ``column_tags``
    has (table_name, column_name, tags). A document is as wide as its table."""
    no_tags = F.create_map().cast("map<string,string>")
    cols = classified(columns).join(column_tags.withColumnRenamed("tags", "column_tags"), ["table_name", "column_name"], "left")
    item = F.struct(
        "ordinal_position", F.col("column_name").alias("name"), F.col("data_type").alias("type"),
        F.col("column_comment").alias("comment"), (F.col("is_nullable") == "YES").alias("nullable"), "pii",
        F.coalesce("column_tags", no_tags).alias("column_tags"),
    )
    by_position = lambda a, b: F.when(a["ordinal_position"] < b["ordinal_position"], -1).when(
        a["ordinal_position"] > b["ordinal_position"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    docs = cols.groupBy("table_name").agg(
        F.array_sort(F.collect_list(item), by_position).alias("columns"),
        F.max("table_comment").alias("table_comment"),
    )
    return docs.join(table_tags.withColumnRenamed("tags", "table_tags"), "table_name", "left").withColumns({
        "table_tags": F.coalesce("table_tags", no_tags),
        "pii_indicators": F.array_sort(F.array_distinct(F.flatten(F.transform("columns", lambda c: c["pii"])))),
        "security_tags": compliance_tags(F.col("table_comment")),
    })


def tag_list(tags: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def markdown_document(docs: DataFrame) -> DataFrame:
    tagged = F.filter("columns", lambda c: F.size(c["column_tags"]) > 0)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("- **"), F.col("table_name"), F.lit("**")),
        F.when(F.col("table_comment") != "", F.concat(F.lit("  - Description: "), F.col("table_comment"))),
        F.when(F.size("table_tags") > 0, F.concat(F.lit("  - Tags: "), tag_list(F.col("table_tags")))),
        F.when(F.size("pii_indicators") > 0, F.concat(F.lit("  - PII Detected: "), F.array_join("pii_indicators", ", "))),
        F.when(F.size("security_tags") > 0, F.concat(F.lit("  - Compliance: "), F.array_join("security_tags", ", "))),
        F.concat(F.lit("  - Columns: "), F.size("columns").cast("string")),
        F.when(F.size(tagged) > 0, F.array_join(F.transform(tagged, lambda c: F.concat(
            F.lit("    - "), c["name"], F.lit(" ("), c["type"], F.lit("): "), tag_list(c["column_tags"]))), "\n")),
    )
    return docs.select("table_name", lines.alias("document"))


def _column_element(c: Column, sensitive: bool) -> Column:
    attrs = F.concat(
        F.lit('name="'), c["name"], F.lit('" type="'), c["type"], F.lit('" '),
        F.when(c["nullable"], "nullable").otherwise("required"),
    )
    if sensitive:
        return F.concat(F.lit("    <column "), attrs, F.lit(' pii="'), F.array_join(c["pii"], ", "), F.lit('">Sensitive</column>'))
    comment = F.replace(F.replace(c["comment"], F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(F.coalesce(c["comment"], F.lit("")) != "", F.concat(
        F.lit("    <column "), attrs, F.lit(">"), comment, F.lit("</column>"))).otherwise(
        F.concat(F.lit("    <column "), attrs, F.lit(" />")))


def xml_document(docs: DataFrame) -> DataFrame:
    """Sensitive columns first; of more than ten others the first and last five."""
    pii = F.filter("columns", lambda c: F.size(c["pii"]) > 0)
    rest = F.filter("columns", lambda c: F.size(c["pii"]) == 0)
    plain = lambda items: F.transform(items, lambda c: _column_element(c, False))
    shown = F.when(F.size(rest) > 10, F.concat(
        plain(F.slice(rest, 1, 5)),
        F.array(F.concat(F.lit("    <!-- ... "), (F.size(rest) - 10).cast("string"), F.lit(" more columns ... -->"))),
        plain(F.slice(rest, -5, 5)),
    )).otherwise(plain(rest))
    text = F.concat_ws(
        "\n", F.concat(F.lit('<table name="'), F.col("table_name"), F.lit('">')),
        F.when(F.size("security_tags") > 0, F.concat(F.lit("  <compliance_tags>"), F.array_join("security_tags", ", "), F.lit("</compliance_tags>"))),
        F.concat(F.lit('  <columns count="'), F.size("columns").cast("string"), F.lit('">')),
        F.array_join(F.concat(F.transform(pii, lambda c: _column_element(c, True)), shown), "\n"),
        F.lit("  </columns>\n</table>"),
    )
    return docs.select("table_name", text.alias("document"))


def condensed_columns(columns: DataFrame, edge: int = 5) -> DataFrame:
    """The rows of a condensed column list, with a marker row for what is left out."""
    cols = classified(columns).withColumn("is_pii", F.size("pii") > 0)
    order = [F.col("ordinal_position"), F.col("column_name")]
    part = W.partitionBy("table_name", "is_pii")
    ranked = cols.withColumns({
        "rn": F.row_number().over(part.orderBy(*order)),
        "n": F.count("*").over(part),
    })
    keep = F.col("is_pii") | (F.col("n") <= 2 * edge) | (F.col("rn") <= edge) | (F.col("rn") > F.col("n") - edge)
    shown = ranked.filter(keep).select("table_name", "is_pii", F.col("rn").cast("bigint").alias("position"), F.col("column_name").alias("entry"))
    marker = ranked.filter(~F.col("is_pii") & (F.col("n") > 2 * edge) & (F.col("rn") == edge + 1)).select(
        "table_name", "is_pii", F.col("rn").cast("bigint").alias("position"),
        F.concat(F.lit("... "), (F.col("n") - 2 * edge).cast("string"), F.lit(" more")).alias("entry"))
    return shown.unionByName(marker)


def assign_tags(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Bulk tag upsert; keys include the tag name."""
    return merge(current, new, keys, ["tag_value"])


def statement_tables(statements: DataFrame) -> DataFrame:
    """Statement id with the sorted full names of the tables it reads or writes."""
    code = lx.masked_code(lx.tokens(F.col("statement_text")))
    df = statements.withColumn("code", code)
    df = df.withColumn("segs", lx.segments(lx.calls_marked(F.col("code"))))
    return df.withColumn("tables", lx.full_table_refs(lx.table_names(F.col("code"), F.col("segs")))).drop("code", "segs")


def tables_by_text(statements: DataFrame) -> DataFrame:
    """(text_key, tables), each text without comments read once over the full shuffle width."""
    width = int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = statements.select(lx.without_comments(F.col("statement_text")).alias("statement_text")).distinct()
    # Keyed by a hash: the same key again would be dropped as redundant and the texts, few
    # bytes but much regex work, would be packed into few tasks.
    found = statement_tables(texts.repartition(width, F.xxhash64("statement_text")))
    return found.select(F.sha2("statement_text", 256).alias("text_key"), "tables")


def table_usage(statements: DataFrame) -> DataFrame:
    """Statements and users per table, counted per (text, user) before the join."""
    key = lx.text_key(F.col("statement_text")).alias("text_key")
    runs = statements.groupBy(key, "executed_by").agg(F.count("*").alias("n"))
    used = runs.join(tables_by_text(statements), "text_key").select(
        "executed_by", "n", F.explode_outer("tables").alias("table_name"))
    return used.filter(F.col("table_name").isNotNull() & ~is_system_table(F.col("table_name"))).groupBy("table_name").agg(
        F.sum("n").alias("statements"), F.count_distinct("executed_by").alias("users"))


def statement_schemas(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """Statement to catalog document of each table it names, system tables left out."""
    refs = tables_by_text(statements).select("text_key", F.explode_outer("tables").alias("table_name")).filter(
        F.col("table_name").isNotNull() & ~is_system_table(F.col("table_name")))
    runs = statements.select("statement_id", lx.text_key(F.col("statement_text")).alias("text_key"))
    return runs.join(refs, "text_key").join(tables, "table_name").drop("text_key")


def name_audit(columns: DataFrame) -> DataFrame:
    full = F.concat_ws(".", "table_name", "column_name")
    return columns.select(
        "table_name", "column_name",
        reference_problem(F.col("column_name")).alias("column_problem"),
        reference_problem(full).alias("path_problem"),
    )
