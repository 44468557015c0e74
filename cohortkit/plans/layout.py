"""Which column of a wide person table plays which part."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """Column names by part. ``key`` is needed for repeatable splits only."""

    key: str | None
    county: str
    age: str
    gender: str
    group: str
    group_detail: str
    income_band: str
    income_amount: str
    area_income: str
    latitude: str
    longitude: str
    voted: str
    plotted_interests: tuple[str, ...]
    model_interests: tuple[str, ...]


# The column names of the registration file this library reads.
VOTER_FILE = Layout(
    key=None,
    county="County",
    age="Voters_Age",
    gender="Voters_Gender",
    group="EthnicGroups_EthnicGroup1Desc",
    group_detail="Ethnic_Description",
    income_band="CommercialData_EstimatedHHIncome",
    income_amount="CommercialData_EstimatedHHIncomeAmount",
    area_income="CommercialData_EstimatedAreaMedianHHIncome",
    latitude="Residence_Addresses_Latitude",
    longitude="Residence_Addresses_Longitude",
    voted="General_2020",
    plotted_interests=(
        "CommercialDataLL_Interest_in_Camping_Hiking_In_Household",
        "CommercialDataLL_Interest_in_Cooking_General_In_Household",
        "CommercialDataLL_Interest_in_Cooking_Gourmet_In_Household",
        "CommercialDataLL_Interest_in_Crafts_In_Household",
        "CommercialDataLL_Interest_in_Current_Affairs_Politics_In_Household",
        "CommercialDataLL_Interest_in_Education_Online_In_Household",
        "CommercialDataLL_Interest_in_Electronic_Gaming_In_Household",
        "CommercialDataLL_Interest_in_Exercise_Health_In_Household",
    ),
    model_interests=(
        "CommercialDataLL_Interest_in_Boating_Sailing_In_Household",
        "CommercialDataLL_Interest_in_Camping_Hiking_In_Household",
        "CommercialDataLL_Interest_in_Cooking_General_In_Household",
        "CommercialDataLL_Interest_in_Cooking_Gourmet_In_Household",
        "CommercialDataLL_Interest_in_Crafts_In_Household",
        "CommercialDataLL_Interest_in_Current_Affairs_Politics_In_Household",
        "CommercialDataLL_Interest_in_Education_Online_In_Household",
        "CommercialDataLL_Interest_in_Electronic_Gaming_In_Household",
        "CommercialDataLL_Interest_in_Exercise_Aerobic_In_Household",
        "CommercialDataLL_Interest_in_Exercise_Health_In_Household",
        "CommercialDataLL_Interest_in_Exercise_Running_Jogging_In_Household",
    ),
)

# The table of cohortkit.sources.people.
PEOPLE = Layout(
    key="person_id",
    county="county",
    age="age",
    gender="gender",
    group="ethnic_group",
    group_detail="ethnic_group",
    income_band="income_band",
    income_amount="income_amount",
    area_income="area_income",
    latitude="latitude",
    longitude="longitude",
    voted="voted",
    plotted_interests=("interest_a", "interest_b", "interest_c"),
    model_interests=("interest_a", "interest_b", "interest_c"),
)
