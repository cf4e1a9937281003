"""Long views over the wide provider table.

Input columns carry the header names of the public provider file after
`clean_columns`; output columns are short. Nothing is sorted here: a sort
inside a view would be paid by every reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweft.functions.predicates import country_scope
from careweft.operators.slots import unpivot_roles, unpivot_slots

# Header names of the core columns and their short names.
CORE = {
    "NPI": "npi",
    "Entity_Type_Code": "entity_type_code",
    "Replacement_NPI": "replacement_npi",
    "Employer_Identification_Number_EIN": "ein",
    "Is_Sole_Proprietor": "is_sole_proprietor",
    "Is_Organization_Subpart": "is_organization_subpart",
    "Parent_Organization_LBN": "parent_organization_legal_business_name",
    "Parent_Organization_TIN": "parent_organization_tin",
    "Provider_Gender_Code": "gender_code",
    "Provider_Enumeration_Date": "enumeration_date",
    "Certification_Date": "certification_date",
    "NPI_Deactivation_Reason_Code": "deactivation_reason_code",
    "NPI_Deactivation_Date": "deactivation_date",
    "NPI_Reactivation_Date": "reactivation_date",
    "Last_Update_Date": "last_update_date",
}
ORGANIZATION = "Provider_Organization_Name_Legal_Business_Name"
OTHER_TYPES = [
    "Provider_Other_Organization_Name_Type_Code",
    "Provider_Other_Last_Name_Type_Code",
]
IDENTIFIER_SLOTS = 50
TAXONOMY_SLOTS = 15
# Slots whose published filter tests the taxonomy group of slot 1.
PUBLISHED_GROUP_SLOTS = range(2, 9)


def npi_core(providers: DataFrame) -> DataFrame:
    """The fifteen core columns, seven of them renamed."""
    return providers.select(*[F.col(c).alias(short) for c, short in CORE.items()])


def _person(prefix: str, last: str) -> dict[str, str]:
    return {
        "last_name": prefix + last,
        "first_name": prefix + "First_Name",
        "middle_name": prefix + "Middle_Name",
        "name_prefix": prefix + "Name_Prefix_Text",
        "name_suffix": prefix + "Name_Suffix_Text",
        "credential": prefix + "Credential_Text",
    }


def provider_names(providers: DataFrame) -> DataFrame:
    """Primary, other and authorized-official names, one row each.

    The authorized row repeats the organization name and is kept for its sake,
    so every organization has one.
    """
    primary = _person("Provider_", "Last_Name_Legal_Name")
    other = _person("Provider_Other_", "Last_Name")
    official = _person("Authorized_Official_", "Last_Name")

    def role(name, type_code, organization, person, more_tests=()):
        columns = {
            "role": F.lit(name),
            "other_type_code": type_code,
            "organization_name": organization,
            **person,
        }
        return columns, [*more_tests, organization, *person.values()]

    roles = [
        role("Primary", None, ORGANIZATION, primary),
        role(
            "Other", F.coalesce(*OTHER_TYPES), "Provider_Other_Organization_Name", other,
            OTHER_TYPES,
        ),
        role("Authorized", None, ORGANIZATION, official),
    ]
    return unpivot_roles(providers.withColumnRenamed("NPI", "npi"), ["npi"], roles)


def _business_address(kind: str) -> dict[str, str]:
    rest = f"Provider_Business_{kind}_Address_"
    return {
        "address1": f"Provider_First_Line_Business_{kind}_Address",
        "address2": f"Provider_Second_Line_Business_{kind}_Address",
        "city": rest + "City_Name",
        "state": rest + "State_Name",
        "postal_code": rest + "Postal_Code",
        "country_code": rest + "Country_Code_If_outside_US",
        "phone": rest + "Telephone_Number",
        "fax": rest + "Fax_Number",
    }


def _secondary_address() -> dict[str, str]:
    rest = "Provider_Secondary_Practice_Location_Address_"
    return {
        "address1": rest + "Address_Line_1",
        "address2": rest + "Address_Line_2",
        "city": rest + "City_Name",
        "state": rest + "State_Name",
        "postal_code": rest + "Postal_Code",
        "country_code": rest + "Country_Code_If_outside_US",
        "phone": rest + "Telephone_Number",
        "phone_ext": rest + "Telephone_Extension",
        "fax": "Provider_Practice_Location_Address_Fax_Number",
    }


def _address_columns(purpose: str, names: dict[str, str]) -> dict:
    return {
        "purpose": F.lit(purpose),
        **{c: names[c] for c in ("address1", "address2", "city", "state", "postal_code")},
        "country_code": names["country_code"],
        "type": country_scope(names["country_code"]),
        "phone": names["phone"],
        "phone_ext": names.get("phone_ext"),
        "fax": names["fax"],
    }


def provider_addresses(
    providers: DataFrame, locations: DataFrame, published_filter: bool = False
) -> DataFrame:
    """Mailing, primary and secondary addresses with a domestic/foreign type.

    `published_filter` leaves line 2 of secondary addresses out of the
    any-value test, as the published view does.
    """
    roles = []
    for purpose, kind in (("Mailing", "Mailing"), ("Primary Location", "Practice_Location")):
        names = _business_address(kind)
        roles.append((_address_columns(purpose, names), list(names.values())))
    own = unpivot_roles(providers.withColumnRenamed("NPI", "npi"), ["npi"], roles)
    names = _secondary_address()
    tested = [n for c, n in names.items() if not (published_filter and c == "address2")]
    more = unpivot_roles(
        locations.withColumnRenamed("NPI", "npi"),
        ["npi"],
        [(_address_columns("Secondary Location", names), tested)],
    )
    return own.unionByName(more)


def provider_identifiers(providers: DataFrame, n: int = IDENTIFIER_SLOTS) -> DataFrame:
    """One row per filled identifier slot."""
    lead = "Other_Provider_Identifier_"
    fields = {
        "identifier": lead + "{i}",
        "identifier_type_code": lead + "Type_Code_{i}",
        "identifier_state": lead + "State_{i}",
        "identifier_issuer": lead + "Issuer_{i}",
    }
    return unpivot_slots(
        providers.withColumnRenamed("NPI", "npi"), ["npi"], fields, n, "identifier_number"
    )


def provider_taxonomies(
    providers: DataFrame,
    n: int = TAXONOMY_SLOTS,
    text_slot: bool = False,
    published_filter: bool = False,
) -> DataFrame:
    """One row per filled taxonomy slot.

    The published view numbers slots as text and tests the group of slot 1 in
    slots 2 to 8; both are off here unless asked for.
    """
    fields = {
        "taxonomy_code": "Healthcare_Provider_Taxonomy_Code_{i}",
        "taxonomy_group": "Healthcare_Provider_Taxonomy_Group_{i}",
        "license_number": "Provider_License_Number_{i}",
        "license_state_code": "Provider_License_Number_State_Code_{i}",
        "primary_switch": "Healthcare_Provider_Primary_Taxonomy_Switch_{i}",
    }
    keep_if = {"taxonomy_group": PUBLISHED_GROUP_SLOTS} if published_filter else None
    return unpivot_slots(
        providers.withColumnRenamed("NPI", "npi"),
        ["npi"],
        fields,
        n,
        "taxonomy_number",
        text_slot,
        keep_if,
    )

