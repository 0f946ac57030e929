"""Schemas, enums and fixed values of the pay-survey data model."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the survey definitions for results to
# match: per-survey CSV headers, default labels, caps, and search synonyms.
# ---------------------------------------------------------------------------

#: canonical field -> CSV header, per survey file (None: survey lacks it)
SURVEY_HEADERS: dict[str, dict[str, str | None]] = {
    "salary_survey-1.csv": {
        "timestamp": "Timestamp",
        "employer": None,
        "location": "Where are you located? (City/state/country)",
        "job_title": "Job title",
        "years_experience_industry":
            "How many years of post-college professional work experience do you have?",
        "years_experience_company": None,
        "annual_base_pay": "What is your annual salary?",
        "signing_bonus": None,
        "annual_bonus": None,
        "stock_value": None,
        "health_insurance_offered": None,
        "annual_vacation_weeks": None,
        "industry": "What industry do you work in?",
        "employment_type": None,
        "is_manager": None,
        "level": None,
        "required_hours_per_week": None,
        "actual_hours_per_week": None,
        "highest_level_of_formal_education": None,
        "gender": None,
        "final_question": "If your job title needs additional context, please clarify here:",
    },
    "salary_survey-2.csv": {
        "timestamp": "Timestamp",
        "employer": "Company Name",
        "location": "Primary Location (City)",
        "job_title": "Job Title In Company",
        "years_experience_industry": "Years Experience in Industry",
        "years_experience_company": "Years of Experience in Current Company  ",
        "annual_base_pay": "Total Base Salary in 2018 (in USD)",
        "signing_bonus": None,
        "annual_bonus": "Total Bonus in 2018 (cumulative annual value in USD)",
        "stock_value": "Total Stock Options/Equity in 2018 (cumulative annual value in USD)",
        "health_insurance_offered": "Health Insurance Offered",
        "annual_vacation_weeks": "Annual Vacation (in Weeks)",
        "industry": "Industry in Company",
        "employment_type": "Employment Type",
        "is_manager": None,
        "level": "Job Level",
        "required_hours_per_week": "Required Hours Per Week",
        "actual_hours_per_week": "Actual Hours Per Week",
        "highest_level_of_formal_education": "Highest Level of Formal Education Completed",
        "gender": "Gender",
        "final_question": "Final Question: What are the top skills (you define what that means) "
                          "that you believe will be necessary for job growth in your industry "
                          "over the next 10 years?",
    },
    "salary_survey-3.csv": {
        "timestamp": "Timestamp",
        "employer": "Employer",
        "location": "Location",
        "job_title": "Job Title",
        "years_experience_industry": "Years of Experience",
        "years_experience_company": "Years at Employer",
        "annual_base_pay": "Annual Base Pay",
        "signing_bonus": "Signing Bonus",
        "annual_bonus": "Annual Bonus",
        "stock_value": "Annual Stock Value/Bonus",
        "health_insurance_offered": None,
        "annual_vacation_weeks": None,
        "industry": None,
        "employment_type": None,
        "is_manager": None,
        "level": None,
        "required_hours_per_week": None,
        "actual_hours_per_week": None,
        "highest_level_of_formal_education": None,
        "gender": "Gender",
        "final_question": "Additional Comments",
    },
}

#: the order in which survey files are loaded
SURVEY_FILES = ("salary_survey-1.csv", "salary_survey-2.csv", "salary_survey-3.csv")

#: raw fields, in mapping order
RAW_FIELDS = tuple(SURVEY_HEADERS["salary_survey-1.csv"].keys())

#: labels used when a text field is missing
UNKNOWN_COMPANY = "Unknown Company"
UNKNOWN_LOCATION = "Unknown Location"
UNKNOWN_POSITION = "Unknown Position"
UNKNOWN_INDUSTRY = "Unknown Industry"
UNKNOWN = "Unknown"

#: money cap (cents) and experience cap
MONEY_CAP_CENTS = 99_999_999_999
EXPERIENCE_OUTLIER = 99
EXPERIENCE_REPLACEMENT = 50

#: boolean words
TRUE_WORDS = ("yes", "true", "1", "y", "offered")
FALSE_WORDS = ("no", "false", "0", "n", "not offered")
STRICT_TRUE_WORDS = ("yes", "true", "1")
STRICT_FALSE_WORDS = ("no", "false", "0")

#: quality score of the strict SQL loader
STRICT_QUALITY_SCORE = 85.5

#: job-title synonym groups of the search analyzer
TITLE_SYNONYMS = (
    ("software engineer", "swe", "developer", "programmer", "coder"),
    ("data scientist", "data analyst", "analyst"),
    ("product manager", "pm", "product owner"),
    ("senior", "sr", "lead", "principal"),
    ("junior", "jr", "entry level"),
    ("manager", "mgr", "supervisor"),
    ("director", "dir", "head"),
    ("vice president", "vp"),
    ("chief technology officer", "cto"),
    ("chief executive officer", "ceo"),
)

#: total-compensation bands (dollars, exclusive upper bound)
COMPENSATION_RANGES = (
    (50_000, "Entry Level"),
    (100_000, "Mid Level"),
    (200_000, "Senior Level"),
    (None, "Executive Level"),
)

#: experience levels (years, exclusive upper bound)
EXPERIENCE_LEVELS = (
    (2, "Junior"),
    (5, "Mid-Level"),
    (10, "Senior"),
    (None, "Expert"),
)

#: experience brackets (years, exclusive upper bound); NULL falls in the last
EXPERIENCE_BRACKETS = (
    (2, "0-2 years"),
    (5, "2-5 years"),
    (10, "5-10 years"),
    (None, "10+ years"),
)

#: list defaults
DEFAULT_PAGE_LIMIT = 20
MAX_PAGE_LIMIT = 100
DEFAULT_KEYWORD = "engineer"

# ---------------------------------------------------------------------------
# enums of the API
# ---------------------------------------------------------------------------


class SortDirection(str, Enum):
    ASC = "ASC"
    DESC = "DESC"


class SortField(str, Enum):
    TIMESTAMP = "timestamp"
    ANNUAL_BASE_PAY = "annual_base_pay"
    ANNUAL_BONUS = "annual_bonus"
    YEARS_EXPERIENCE_INDUSTRY = "years_experience_industry"
    YEARS_EXPERIENCE_COMPANY = "years_experience_company"
    CREATED_AT = "created_at"


class EmploymentType(str, Enum):
    FULL_TIME = "FULL_TIME"
    PART_TIME = "PART_TIME"
    CONTRACT = "CONTRACT"
    FREELANCE = "FREELANCE"
    INTERN = "INTERN"


class Gender(str, Enum):
    MALE = "MALE"
    FEMALE = "FEMALE"
    NON_BINARY = "NON_BINARY"
    OTHER = "OTHER"
    PREFER_NOT_TO_SAY = "PREFER_NOT_TO_SAY"


# ---------------------------------------------------------------------------
# canonical table
# ---------------------------------------------------------------------------

EXPERIENCE_TYPE = T.DecimalType(5, 2)

PAY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source_file", T.StringType(), False),
    T.StructField("row_number", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("employer", T.StringType()),
    T.StructField("company_size", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("public_private", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state_province", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("job_title", T.StringType()),
    T.StructField("job_ladder", T.StringType()),
    T.StructField("job_level", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("years_experience_industry", EXPERIENCE_TYPE),
    T.StructField("years_experience_company", EXPERIENCE_TYPE),
    T.StructField("years_at_employer", EXPERIENCE_TYPE),
    T.StructField("annual_base_pay", T.LongType()),
    T.StructField("annual_bonus", T.LongType()),
    T.StructField("signing_bonus", T.LongType()),
    T.StructField("stock_value", T.LongType()),
    T.StructField("required_hours_per_week", T.IntegerType()),
    T.StructField("actual_hours_per_week", T.IntegerType()),
    T.StructField("annual_vacation_weeks", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("education_level", T.StringType()),
    T.StructField("is_happy_at_position", T.BooleanType()),
    T.StructField("plans_to_resign", T.BooleanType()),
    T.StructField("health_insurance_offered", T.BooleanType()),
    T.StructField("additional_comments", T.StringType()),
    T.StructField("data_quality_score", EXPERIENCE_TYPE),
    T.StructField("is_validated", T.BooleanType()),
])

PAY_COLUMNS = tuple(f.name for f in PAY_SCHEMA.fields)

#: VARCHAR limits of the canonical table (check_constraints)
VARCHAR_LIMITS = {
    "source_file": 100, "employer": 500, "company_size": 100, "industry": 200,
    "public_private": 20, "location": 500, "city": 200, "state_province": 100,
    "country": 100, "job_title": 500, "job_ladder": 200, "job_level": 100,
    "employment_type": 100, "gender": 100, "education_level": 300,
}

#: change-feed payload
CHANGE_DATA_FIELDS = (
    "id", "source_file", "row_number", "timestamp", "employer", "location", "job_title",
    "industry", "gender", "employment_type", "years_experience_industry",
    "years_experience_company", "annual_base_pay", "annual_bonus", "stock_value",
)

# ---------------------------------------------------------------------------
# DECISIONS (not fixed by the survey service): job-title classification used
# by the job_titles dimension.  First matching rule wins; patterns run on the
# lower-cased title.
# ---------------------------------------------------------------------------

TITLE_CATEGORIES = (
    ("Engineering", r"\b(engineers?|engineering|developers?|programmers?|swe|devops|architects?)\b"),
    ("Data", r"\b(data|analysts?|scientists?|analytics)\b"),
    ("Product", r"\bproducts?\b"),
    ("Design", r"\b(design|designers?|ux|ui)\b"),
    ("Management", r"\b(managers?|directors?|head|vp|vice president|chief|cto|ceo)\b"),
)

TITLE_SENIORITY = (
    ("Intern", r"\b(interns?|internship)\b"),
    ("Junior", r"\b(junior|jr|entry level|associate)\b"),
    ("Executive", r"\b(chief|cto|ceo|vice president|vp|directors?|head)\b"),
    ("Senior", r"\b(senior|sr|lead|principal|staff)\b"),
)
