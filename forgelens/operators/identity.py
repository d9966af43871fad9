"""Who is who: bots, pseudonyms, merged aliases, duplicate identities, the roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions.columns import is_bot, is_generic_name, is_known_bot, normalized_name, pseudonym, stripped
from forgelens.operators.closure import components
from forgelens.sources.files import IdentityFile

IDENTITY_COLUMNS = {"commits": ("author_name", "author_email", "committer_name", "committer_email"), "merge_requests": ("author_name", "author_email")}

# Why two identities may be one person.
REASONS = ("exact_name_match", "same_local_part", "normalized_name_match")


def detected_bots(developers: DataFrame, more_names: tuple[str, ...] = ()) -> DataFrame:
    return developers.filter(is_known_bot(F.col("name"), F.col("email"), more_names))


def new_bots(developers: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Bots of which neither name nor e-mail is excluded already."""
    found = detected_bots(developers)
    return found.filter(~F.coalesce(F.col("email").isin(*excluded), F.lit(False)) & ~F.coalesce(F.col("name").isin(*excluded), F.lit(False))) if excluded else found


def resolve_aliases(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """aliases: alias, canonical. One hop, without regard to case; a value without an alias stays, and of several canonical ones the least counts."""
    known = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    joined = rows.join(known, F.lower(F.col(column)) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def anonymized(rows: DataFrame, columns: tuple[str, ...], key: str, aliases: DataFrame | None = None) -> DataFrame:
    """Columns as pseudonyms of the resolved values; null and empty ones stay. Names and e-mails are resolved one by one."""
    for c in columns:
        if aliases is not None:
            rows = resolve_aliases(rows, c, aliases)
        rows = rows.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col(c)).otherwise(pseudonym(F.col(c), key)))
    return rows


def identity_map(rows: DataFrame, key: str, order: str) -> DataFrame:
    """hash, name and e-mail as last seen, by order."""
    named = rows.filter(F.coalesce(F.col("author_email"), F.lit("")) != "")
    last = named.groupBy(pseudonym(F.col("author_email"), key).alias("hash")).agg(F.max_by(F.struct("author_name", "author_email"), F.col(order)).alias("who"))
    return last.select("hash", F.col("who.author_name").alias("name"), F.col("who.author_email").alias("email"))


def deanonymized(rows: DataFrame, known: DataFrame) -> DataFrame:
    """author_name and author_email by the map: by the e-mail's hash, else the name's, else as they are."""
    by_email = known.select(F.col("hash").alias("author_email"), F.col("name").alias("_n1"), F.col("email").alias("_e1"))
    by_name = known.select(F.col("hash").alias("author_name"), F.col("name").alias("_n2"), F.col("email").alias("_e2"))
    joined = rows.join(by_email, "author_email", "left").join(by_name, "author_name", "left")
    return joined.withColumns({"author_name": F.coalesce("_n1", "_n2", "author_name"), "author_email": F.coalesce("_e1", "_e2", "author_email")}).select(*rows.columns)


def duplicate_identities(developers: DataFrame) -> DataFrame:
    """Pairs that may be one person (a comes before b by ord): same name, else same local part, else same normalised name; one row for each pair of e-mails.

    The pairs are the result, as many as the squares of the groups; identity_groups tells the same in as many rows as there are identities.
    """
    usable = developers.filter(~is_generic_name(F.col("name")) | F.col("name").isNull()).select(
        "ord", "name", "email", F.lower(stripped(F.col("name"))).alias("k1"), F.when(F.col("email").contains("@"), F.lower(F.substring_index("email", "@", 1))).alias("k2"), normalized_name(F.col("name")).alias("k3")
    )
    found = None
    for rank, (key, reason) in enumerate(zip(("k1", "k2", "k3"), REASONS)):
        side = lambda s: usable.filter(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(key).alias("k"), *[F.col(c).alias(f"{c}_{s}") for c in ("ord", "name", "email")])  # noqa: B023, E731
        pairs = side("a").join(side("b"), "k").filter((F.col("ord_a") < F.col("ord_b")) & (F.lower("email_a") != F.lower("email_b")))
        pairs = pairs.withColumns({"rank": F.lit(rank), "reason": F.lit(reason)}).drop("k")
        found = pairs if found is None else found.unionByName(pairs)
    low, high = F.least(F.lower("email_a"), F.lower("email_b")), F.greatest(F.lower("email_a"), F.lower("email_b"))
    first = Window.partitionBy(low, high).orderBy("rank", "ord_a", "ord_b")
    return found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("name_a", "email_a", "name_b", "email_b", "reason")


def _shared(developers: DataFrame) -> DataFrame:
    """ord, name, email with reason and k: what an identity may share with others. Generic names share nothing."""
    name, email = F.col("name"), F.col("email")
    keys = [F.lower(stripped(name)), F.when(email.contains("@"), F.lower(F.substring_index(email, "@", 1))), normalized_name(name)]
    kinds = F.array(*[F.struct(F.lit(reason).alias("reason"), k.alias("k")) for reason, k in zip(REASONS, keys)])
    return developers.filter(~is_generic_name(name) | name.isNull()).select("ord", "name", "email", F.inline(kinds)).filter("k <> ''")


def identity_components(developers: DataFrame) -> DataFrame:
    """People: identities that share names, local parts or normalised names, also over others. One row for each identity in a group of several.

    component: its least ord; size: its identities; n_shared: its names, local parts and normalised names that several of them have; canonical_name,
    canonical_email: of its first identity (by ord) with an address, as a suggestion. Identities that share nothing have no row; ord is a key.
    """
    rows = _shared(developers)
    groups = rows.groupBy("reason", "k").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first <> last").select("reason", "k", "first")
    # An identity has one key of each reason, so reason and first identity name a group; the round trips below carry no texts.
    kind = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")).cast("int")
    members = rows.join(groups, ["reason", "k"]).select(F.col("ord").alias("node"), F.struct(kind, F.col("first")).alias("group"))
    found = components(members)
    people = developers.select("ord", "name", "email").join(found.withColumnRenamed("node", "ord"), "ord")
    first = F.min_by(F.struct("name", "email"), F.when(F.col("email").isNotNull(), F.col("ord")))
    named = people.groupBy("component").agg(F.count("*").alias("size"), first.alias("first"))
    shared = groups.select(F.col("first").alias("node")).join(found, "node").groupBy("component").agg(F.count("*").alias("n_shared"))
    whole = people.join(named, "component").join(shared, "component")
    return whole.select("ord", "name", "email", "component", "size", "n_shared", F.col("first.name").alias("canonical_name"), F.col("first.email").alias("canonical_email"))


def identity_groups(developers: DataFrame) -> DataFrame:
    """What duplicate_identities links, without its pairs: each identity but the first (by ord) of those that share a name, local part or normalised name, with that first one and the group's size. As many rows at most as identities and reasons."""
    rows = _shared(developers)
    first = rows.groupBy("reason", "k").agg(F.min("ord").alias("first"), F.min_by("name", "ord").alias("first_name"), F.min_by("email", "ord").alias("first_email"), F.count("*").alias("size")).filter("size > 1")
    return rows.join(first, ["reason", "k"]).filter("ord <> first").select("name", "email", "first_name", "first_email", "reason", "size")


def merged_identities(rows: DataFrame, columns: tuple[str, ...], merges: DataFrame) -> DataFrame:
    """Old hashes replaced by new ones (merges: old, new; of several new ones the least) in each of the columns; running it again changes nothing."""
    known = merges.groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new"))
    for c in columns:
        rows = rows.join(known, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return rows


def merged_counts(rows: DataFrame, columns: tuple[str, ...], merges: DataFrame) -> DataFrame:
    """Values that merged_identities changes, by column."""
    out = None
    for c in columns:
        n = rows.join(merges, F.col(c) == F.col("old"), "left_semi").agg(F.count("*").alias("n_changed")).select(F.lit(c).alias("column_name"), "n_changed")
        out = n if out is None else out.unionByName(n)
    return out


def apply_merges(warehouse, merges: DataFrame, people: IdentityFile | None = None, canonical: dict[str, tuple[str | None, str | None]] | None = None) -> int:
    """Rewrites the identity columns of the warehouse's tables and notes the merges in the file of people (canonical: who the new pseudonyms are); the number of values that changed."""
    changed = 0
    for table, columns in IDENTITY_COLUMNS.items():
        rows = warehouse.table(table)
        changed += merged_counts(rows, columns, merges).agg(F.sum("n_changed")).first()[0]
        warehouse.replace(table, merged_identities(rows, columns, merges).select(*rows.columns))
    if people is not None:  # merges are made by hand, a few at a time
        people.merged({r[0]: r[1] for r in merges.groupBy("old").agg(F.min("new")).collect()}, canonical or {})
    return changed


def distinct_developers(commits: DataFrame) -> DataFrame:
    return commits.select("author_name", "author_email").distinct()


def developer_roster(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author_email", "author_name").agg(F.count("*").alias("commit_count")).orderBy(F.desc("commit_count"), F.asc_nulls_last("author_email"), F.asc_nulls_last("author_name"))


def roster_status(developers: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """By name: its e-mails in order, and Excluded before Bot before Active."""
    out = F.coalesce(F.col("email").isin(*excluded), F.lit(False)) | F.coalesce(F.col("name").isin(*excluded), F.lit(False)) if excluded else F.lit(False)
    level = F.when(out, 2).when(is_bot(F.col("name"), F.col("email")), 1).otherwise(0)
    rows = developers.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("email")), ", ").alias("emails"), F.max(level).alias("level"))
    return rows.select("name", "emails", F.element_at(F.array(F.lit("Active"), F.lit("Bot"), F.lit("Excluded")), F.col("level") + 1).alias("status"))
