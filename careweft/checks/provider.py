"""Wide-to-long provider queries over tables derived from lineitem and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from careweft.checks.common import Registry, table
from careweft.operators.ordered import add_group_index
from careweft.operators.slots import keep_any_not_null
from careweft.plans import provider
from careweft.sources.codes import PROVIDER_CODE_TABLES, decode, provider_code_table
from careweft.sources.values import in_population, values_df

REGISTRY = Registry()

SLOTS = 20
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
]


def wide_orders(spark, sf_dir):
    """FX-WIDE: lines of an order in 20 numbered column groups of 4 fields."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *LINE_ORDER, "l_returnflag", "l_linestatus"
    )
    lines = add_group_index(items, LINE_ORDER, ["l_orderkey"], "slot").filter(
        F.col("slot") <= SLOTS
    )
    low, kept = F.col("l_quantity") <= 40, F.col("l_quantity") <= 45
    shown = ~((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 45))
    fields = {
        "part": F.when(low, F.col("l_partkey").cast("string")),
        "supp": F.when(kept, F.col("l_suppkey").cast("string")),
        "flag": F.when(shown, F.col("l_returnflag")),
        "status": F.when(shown, F.col("l_linestatus")),
    }
    row = F.struct("slot", *[v.alias(n) for n, v in fields.items()])
    packed = lines.groupBy(F.col("l_orderkey").cast("string").alias("NPI")).agg(
        F.array_sort(F.collect_list(row)).alias("s")
    )
    return packed.selectExpr(
        "NPI",
        *[
            f"get(s, {i - 1}).{name} AS {name}_{i}"
            for i in range(1, SLOTS + 1)
            for name in fields
        ],
    )


WIDE_SQL = (
    """
lines AS (
  SELECT l_orderkey, l_quantity, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice
         ) AS slot
  FROM lineitem),
wide AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS npi,
"""
    + ",\n".join(
        f"""  max(CASE WHEN slot = {i} AND l_quantity <= 40 THEN CAST(l_partkey AS VARCHAR) END) AS part_{i},
  max(CASE WHEN slot = {i} AND l_quantity <= 45 THEN CAST(l_suppkey AS VARCHAR) END) AS supp_{i},
  max(CASE WHEN slot = {i} AND NOT (l_returnflag = 'N' AND l_quantity > 45)
           THEN l_returnflag END) AS flag_{i},
  max(CASE WHEN slot = {i} AND NOT (l_returnflag = 'N' AND l_quantity > 45)
           THEN l_linestatus END) AS status_{i}"""
        for i in range(1, SLOTS + 1)
    )
    + "\n  FROM lines GROUP BY l_orderkey)"
)


def _renamed(wide, fields: dict[str, str], n: int):
    """Wide columns under public header names, with empty slots up to n."""
    columns = []
    for i in range(1, n + 1):
        for target, source in fields.items():
            value = f"{source}_{i}" if i <= SLOTS and source else "CAST(NULL AS STRING)"
            columns.append(f"{value} AS {target.format(i=i)}")
    return wide.selectExpr("NPI", *columns)


@REGISTRY.add(
    "identifier_slots",
    f"WITH {WIDE_SQL}\n"
    + "\nUNION ALL\n".join(
        f"SELECT npi, part_{i} AS identifier, {i} AS identifier_number, "
        f"flag_{i} AS identifier_type_code, status_{i} AS identifier_state, "
        f"supp_{i} AS identifier_issuer FROM wide WHERE part_{i} IS NOT NULL "
        f"OR flag_{i} IS NOT NULL OR status_{i} IS NOT NULL OR supp_{i} IS NOT NULL"
        for i in range(1, SLOTS + 1)
    ),
)
def identifier_slots(spark, sf_dir):
    fields = {
        "Other_Provider_Identifier_{i}": "part",
        "Other_Provider_Identifier_Type_Code_{i}": "flag",
        "Other_Provider_Identifier_State_{i}": "status",
        "Other_Provider_Identifier_Issuer_{i}": "supp",
    }
    wide = _renamed(wide_orders(spark, sf_dir), fields, provider.IDENTIFIER_SLOTS)
    return provider.provider_identifiers(wide)


TAXONOMY_FIELDS = {
    "Healthcare_Provider_Taxonomy_Code_{i}": "part",
    "Healthcare_Provider_Taxonomy_Group_{i}": "flag",
    "Provider_License_Number_{i}": "supp",
    "Provider_License_Number_State_Code_{i}": "status",
    "Healthcare_Provider_Primary_Taxonomy_Switch_{i}": "",
}


def _taxonomy_sql(number, group_of) -> str:
    return f"WITH {WIDE_SQL}\n" + "\nUNION ALL\n".join(
        f"SELECT npi, {number(i)} AS taxonomy_number, part_{i} AS taxonomy_code, "
        f"flag_{i} AS taxonomy_group, supp_{i} AS license_number, "
        f"status_{i} AS license_state_code, CAST(NULL AS VARCHAR) AS primary_switch "
        f"FROM wide WHERE part_{i} IS NOT NULL OR flag_{group_of(i)} IS NOT NULL "
        f"OR supp_{i} IS NOT NULL OR status_{i} IS NOT NULL"
        for i in range(1, provider.TAXONOMY_SLOTS + 1)
    )


@REGISTRY.add("taxonomy_slots", _taxonomy_sql(lambda i: i, lambda i: i))
def taxonomy_slots(spark, sf_dir):
    wide = _renamed(wide_orders(spark, sf_dir), TAXONOMY_FIELDS, provider.TAXONOMY_SLOTS)
    return provider.provider_taxonomies(wide)


@REGISTRY.add(
    "taxonomy_slots_published",
    _taxonomy_sql(lambda i: f"'{i}'", lambda i: 1 if 2 <= i <= 8 else i),
)
def taxonomy_slots_published(spark, sf_dir):
    wide = _renamed(wide_orders(spark, sf_dir), TAXONOMY_FIELDS, provider.TAXONOMY_SLOTS)
    return provider.provider_taxonomies(wide, text_slot=True, published_filter=True)


@REGISTRY.add(
    "any_not_null",
    f"""WITH {WIDE_SQL}
    SELECT npi, part_5, supp_5, flag_5, status_5 FROM wide
    WHERE part_5 IS NOT NULL OR supp_5 IS NOT NULL OR flag_5 IS NOT NULL OR status_5 IS NOT NULL""",
)
def any_not_null(spark, sf_dir):
    five = ["part_5", "supp_5", "flag_5", "status_5"]
    wide = wide_orders(spark, sf_dir).select(F.col("NPI").alias("npi"), *five)
    return keep_any_not_null(wide, five)


@REGISTRY.add(
    "group_index",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity,
              row_number() OVER w AS line_index, 10 + (row_number() OVER w - 1) * 5 AS line_code
       FROM lineitem
       WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                    l_shipdate, l_quantity, l_extendedprice)""",
)
def group_index(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    one = add_group_index(items, LINE_ORDER, ["l_orderkey"], "line_index")
    both = add_group_index(one, LINE_ORDER, ["l_orderkey"], "line_code", base=10, step=5)
    return both.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("long").alias("quantity"),
        "line_index",
        "line_code",
    )


def party(spark, sf_dir):
    """FX-PARTY: customers as wide provider rows."""
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    person, organization = key % 2 == 0, key % 2 == 1
    other, official = key % 5 == 0, key % 3 == 0
    country = F.when(F.col("c_nationkey") % 3 == 1, "US").when(
        F.col("c_nationkey") % 3 == 2, F.col("n_name")
    )
    null = F.lit(None).cast("string")
    columns = {
        "NPI": key.cast("string"),
        "Entity_Type_Code": (1 + key % 2).cast("string"),
        "Replacement_NPI": null,
        "Employer_Identification_Number_EIN": (key * 7).cast("string"),
        "Is_Sole_Proprietor": F.when(person, "N"),
        "Is_Organization_Subpart": F.when(organization, "N"),
        "Parent_Organization_LBN": F.when(organization & (key % 4 == 1), F.col("c_name")),
        "Parent_Organization_TIN": null,
        "Provider_Gender_Code": F.when(person, F.when(key % 4 == 0, "F").otherwise("M")),
        "Provider_Enumeration_Date": F.lit("01/02/2010"),
        "Certification_Date": null,
        "NPI_Deactivation_Reason_Code": null,
        "NPI_Deactivation_Date": null,
        "NPI_Reactivation_Date": null,
        "Last_Update_Date": F.lit("03/04/2020"),
        provider.ORGANIZATION: F.when(organization, F.col("c_name")),
        "Provider_Last_Name_Legal_Name": F.when(person, F.col("c_name")),
        "Provider_First_Name": F.when(person, F.col("c_mktsegment")),
        "Provider_Other_Organization_Name": F.when(other & organization, F.col("n_name")),
        "Provider_Other_Organization_Name_Type_Code": F.when(other & organization, "3"),
        "Provider_Other_Last_Name": F.when(other & person, F.col("n_name")),
        "Provider_Other_Last_Name_Type_Code": F.when(other & person, "1"),
        "Authorized_Official_Last_Name": F.when(official, F.col("n_name")),
        "Authorized_Official_First_Name": F.when(official, F.col("c_mktsegment")),
    }
    for group in ("Provider_", "Provider_Other_", "Authorized_Official_"):
        for name in ("First_Name", "Middle_Name", "Name_Prefix_Text", "Name_Suffix_Text",
                     "Credential_Text"):
            columns.setdefault(group + name, null)
    for kind in ("Mailing", "Practice_Location"):
        rest = f"Provider_Business_{kind}_Address_"
        columns |= {
            f"Provider_First_Line_Business_{kind}_Address": F.col("c_name")
            if kind == "Mailing"
            else F.when(key % 4 != 0, F.col("c_name")),
            f"Provider_Second_Line_Business_{kind}_Address": null,
            rest + "City_Name": F.col("n_name") if kind == "Mailing" else null,
            rest + "State_Name": null,
            rest + "Postal_Code": null,
            rest + "Country_Code_If_outside_US": country if kind == "Mailing" else null,
            rest + "Telephone_Number": null,
            rest + "Fax_Number": null,
        }
    return c.select(*[v.alias(n) for n, v in columns.items()])


def locations(spark, sf_dir):
    """FX-PARTY: suppliers as secondary practice locations."""
    s = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    key, rest = F.col("s_suppkey"), "Provider_Secondary_Practice_Location_Address_"
    null = F.lit(None).cast("string")
    bare = key % 8 == 0  # rows with line 2 alone
    return s.select(
        key.cast("string").alias("NPI"),
        F.when(key % 4 != 0, F.col("s_name")).alias(rest + "Address_Line_1"),
        F.when(key % 2 == 0, "Suite 2").alias(rest + "Address_Line_2"),
        F.when(~bare, F.col("n_name")).alias(rest + "City_Name"),
        null.alias(rest + "State_Name"),
        null.alias(rest + "Postal_Code"),
        F.when(~bare, "US").alias(rest + "Country_Code_If_outside_US"),
        null.alias(rest + "Telephone_Number"),
        F.when(~bare, (key % 100).cast("string")).alias(rest + "Telephone_Extension"),
        null.alias("Provider_Practice_Location_Address_Fax_Number"),
    )


@REGISTRY.add(
    "npi_core_projection",
    """SELECT CAST(c_custkey AS VARCHAR) AS npi, CAST(1 + c_custkey % 2 AS VARCHAR) AS entity_type_code,
           CAST(NULL AS VARCHAR) AS replacement_npi, CAST(c_custkey * 7 AS VARCHAR) AS ein,
           CASE WHEN c_custkey % 2 = 0 THEN 'N' END AS is_sole_proprietor,
           CASE WHEN c_custkey % 2 = 1 THEN 'N' END AS is_organization_subpart,
           CASE WHEN c_custkey % 4 = 1 THEN c_name END AS parent_organization_legal_business_name,
           CAST(NULL AS VARCHAR) AS parent_organization_tin,
           CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 2 THEN 'M' END AS gender_code,
           '01/02/2010' AS enumeration_date, CAST(NULL AS VARCHAR) AS certification_date,
           CAST(NULL AS VARCHAR) AS deactivation_reason_code,
           CAST(NULL AS VARCHAR) AS deactivation_date, CAST(NULL AS VARCHAR) AS reactivation_date,
           '03/04/2020' AS last_update_date
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def npi_core_projection(spark, sf_dir):
    return provider.npi_core(party(spark, sf_dir))


NO_TEXT = "CAST(NULL AS VARCHAR)"


@REGISTRY.add(
    "role_union_names",
    f"""WITH p AS (SELECT *, CAST(c_custkey AS VARCHAR) AS npi
                   FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT npi, 'Primary' AS role, {NO_TEXT} AS other_type_code,
           CASE WHEN c_custkey % 2 = 1 THEN c_name END AS organization_name,
           CASE WHEN c_custkey % 2 = 0 THEN c_name END AS last_name,
           CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS first_name,
           {NO_TEXT} AS middle_name, {NO_TEXT} AS name_prefix, {NO_TEXT} AS name_suffix,
           {NO_TEXT} AS credential FROM p
    UNION ALL
    SELECT npi, 'Other', CASE WHEN c_custkey % 2 = 1 THEN '3' ELSE '1' END,
           CASE WHEN c_custkey % 2 = 1 THEN n_name END, CASE WHEN c_custkey % 2 = 0 THEN n_name END,
           NULL, NULL, NULL, NULL, NULL FROM p WHERE c_custkey % 5 = 0
    UNION ALL
    SELECT npi, 'Authorized', NULL, CASE WHEN c_custkey % 2 = 1 THEN c_name END,
           CASE WHEN c_custkey % 3 = 0 THEN n_name END,
           CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, NULL, NULL, NULL, NULL
    FROM p WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0""",
)
def role_union_names(spark, sf_dir):
    return provider.provider_names(party(spark, sf_dir))


def _address_sql(line2: str) -> str:
    return f"""WITH p AS (SELECT *, CAST(c_custkey AS VARCHAR) AS npi,
                          CASE c_nationkey % 3 WHEN 1 THEN 'US' WHEN 2 THEN n_name END AS country
                   FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT CAST(s_suppkey AS VARCHAR) AS npi,
                 CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS line1,
                 CASE WHEN s_suppkey % 2 = 0 THEN 'Suite 2' END AS line2,
                 CASE WHEN s_suppkey % 8 <> 0 THEN n_name END AS city,
                 CASE WHEN s_suppkey % 8 <> 0 THEN 'US' END AS country,
                 CASE WHEN s_suppkey % 8 <> 0 THEN CAST(s_suppkey % 100 AS VARCHAR) END AS ext
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT npi, 'Mailing' AS purpose, c_name AS address1, {NO_TEXT} AS address2, n_name AS city,
           {NO_TEXT} AS state, {NO_TEXT} AS postal_code, country AS country_code,
           CASE WHEN country = 'US' THEN 'Domestic' WHEN country IS NULL THEN 'Domestic'
                ELSE 'Foreign' END AS type,
           {NO_TEXT} AS phone, {NO_TEXT} AS phone_ext, {NO_TEXT} AS fax FROM p
    UNION ALL
    SELECT npi, 'Primary Location', c_name, NULL, NULL, NULL, NULL, NULL, 'Domestic', NULL, NULL,
           NULL FROM p WHERE c_custkey % 4 <> 0
    UNION ALL
    SELECT npi, 'Secondary Location', line1, line2, city, NULL, NULL, country, 'Domestic', NULL,
           ext, NULL FROM s
    WHERE line1 IS NOT NULL OR {line2} IS NOT NULL OR city IS NOT NULL OR country IS NOT NULL
       OR ext IS NOT NULL"""


@REGISTRY.add("address_purpose_union", _address_sql("line2"))
def address_purpose_union(spark, sf_dir):
    return provider.provider_addresses(party(spark, sf_dir), locations(spark, sf_dir))


@REGISTRY.add("address_purpose_union_published", _address_sql("line1"))
def address_purpose_union_published(spark, sf_dir):
    return provider.provider_addresses(
        party(spark, sf_dir), locations(spark, sf_dir), published_filter=True
    )


@REGISTRY.add(
    "code_table_decode",
    """WITH o AS (
      SELECT o_orderkey, CAST(1 + o_orderkey % 3 AS VARCHAR) AS entity,
             substr('AKTXZZQQ', CAST(1 + 2 * (o_custkey % 4) AS INTEGER), 2) AS state_code,
             substr('ADGBKRQQ', CAST(1 + 2 * (o_orderkey % 4) AS INTEGER), 2) AS country_code,
             substr('XYNQ', CAST(1 + o_custkey % 4 AS INTEGER), 1) AS sole FROM orders)
    SELECT o_orderkey, entity_type, state, state_type, country, sole_proprietor FROM o
    LEFT JOIN (VALUES ('1', 'Individual'), ('2', 'Organization')) e(c, entity_type)
      ON e.c = o.entity
    LEFT JOIN (VALUES ('AK', 'ALASKA', 'State'), ('TX', 'TEXAS', 'State'),
                      ('ZZ', 'Foreign Country', 'Territory')) s(c, state, state_type)
      ON s.c = o.state_code
    LEFT JOIN (VALUES ('AD', 'ANDORRA'), ('GB', 'Great Britain (UK)'),
                      ('KR', 'KOREA, REPUBLIC OF')) k(c, country) ON k.c = o.country_code
    LEFT JOIN (VALUES ('X', 'Not Answered'),
        ('Y', 'Yes, Entity Type 1 Provider (Individual) is a Sole Proprietor'),
        ('N', 'No, Entity Type 1 Provider (Individual) is not a Sole Proprietor'))
      p(c, sole_proprietor) ON p.c = o.sole""",
)
def code_table_decode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    def pick(text: str, width: int, by):
        return F.substring(F.lit(text), (1 + width * by).cast("int"), F.lit(width))

    coded = orders.select(
        "o_orderkey",
        (1 + F.col("o_orderkey") % 3).cast("string").alias("entity"),
        pick("AKTXZZQQ", 2, F.col("o_custkey") % 4).alias("state_code_"),
        pick("ADGBKRQQ", 2, F.col("o_orderkey") % 4).alias("country_code_"),
        pick("XYNQ", 1, F.col("o_custkey") % 4).alias("sole"),
    )
    steps = [
        ("entity", "entity_type", "entity_type_code", ["entity_type"]),
        ("state_code_", "state", "state_code", ["state", "state_type"]),
        ("country_code_", "country", "country_code", ["country"]),
        ("sole", "sole_proprietor", "sole_proprietor_code", ["sole_proprietor"]),
    ]
    for column, name, code, texts in steps:
        coded = decode(coded, column, provider_code_table(spark, name), code, texts)
    return coded.select(
        "o_orderkey", "entity_type", "state", "state_type", "country", "sole_proprietor"
    )


@REGISTRY.add(
    "code_table_usage",
    """WITH codes(name, code) AS (VALUES
      ('entity_type', '1'), ('entity_type', '2'), ('gender', 'M'), ('gender', 'F'),
      ('sole_proprietor', 'N'), ('subpart', 'N'), ('primary_taxonomy', 'N'),
      ('identifier_issuer', '01'), ('identifier_issuer', '05'), ('endpoint_type', 'WEB'),
      ('other_name_type', '1'), ('other_name_type', '2'), ('other_name_type', '3'),
      ('other_name_type', '4'), ('other_name_type', '5'), ('endpoint_affiliation', 'N'),
      ('name_suffix', 'I'), ('state', 'IN'), ('country', 'IN'))
    SELECT c.name AS code_table, c.code, count(*) AS parts
    FROM codes c JOIN (SELECT unnest([CAST(p_size % 7 AS VARCHAR), '0' || CAST(p_size % 7 AS VARCHAR),
        substr('MFNIWEBIN', CAST(1 + p_partkey % 4 AS INTEGER), 1),
        substr('WEBIN', CAST(1 + 3 * (p_partkey % 2) AS INTEGER), 3)]) AS code FROM part) p
      ON p.code = c.code
    GROUP BY c.name, c.code""",
)
def code_table_usage(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = (F.col("p_size") % 7).cast("string")
    key = F.col("p_partkey")
    seen = part.select(
        F.explode(
            F.array(
                size,
                F.concat(F.lit("0"), size),
                F.substring(F.lit("MFNIWEBIN"), (1 + key % 4).cast("int"), F.lit(1)),
                F.substring(F.lit("WEBIN"), (1 + 3 * (key % 2)).cast("int"), F.lit(3)),
            )
        ).alias("code")
    )
    codes = None
    for name in PROVIDER_CODE_TABLES:
        rows = provider_code_table(spark, name)
        rows = rows.select(F.lit(name).alias("code_table"), F.col(rows.columns[0]).alias("code"))
        codes = rows if codes is None else codes.unionByName(rows)
    counted = seen.groupBy("code").agg(F.count(F.lit(1)).alias("parts"))
    return F.broadcast(codes).join(counted, "code").select("code_table", "code", "parts")


POPULATION = [(7, "BUILDING"), (8, None), (None, None), (7, "BUILDING"), (21, "AUTOMOBILE")]


@REGISTRY.add(
    "population_of_many_keys",
    """SELECT l_orderkey, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
       FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 495000)
       GROUP BY l_orderkey""",
)
def population_of_many_keys(spark, sf_dir):
    """The way of a list too long to broadcast, taken for any length."""
    chosen = table(spark, sf_dir, "orders").filter("o_totalprice > 495000").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    kept = in_population(lines, chosen, ["l_orderkey"], small=0)
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("double").alias("price"))


@REGISTRY.add(
    "values_population",
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
       WHERE o_custkey IN (SELECT k FROM (VALUES (7), (8), (NULL), (7), (21)) v(k))""",
)
def values_population(spark, sf_dir):
    chosen = values_df(
        spark, POPULATION, "o_custkey bigint, segment string", distinct=True
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return in_population(orders, chosen, ["o_custkey"])
