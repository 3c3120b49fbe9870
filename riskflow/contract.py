"""Names and fixed values of the survey data model.

Everything here is data: column names, encodings, fallback values and report
wording that results depend on.
"""

from __future__ import annotations

# Raw survey header -> short column name, in model order.
# The order of FEATURES is the contract between features and parameters.
RAW_FEATURES = {
    "Age": "age",
    "CGPA": "cgpa",
    "Academic Pressure": "academic_pressure",
    "Study Satisfaction": "study_satisfaction",
    "Financial Stress": "financial_stress",
    "Sleep Duration": "sleep_duration",
    "Gender": "gender",
    "Family History of Mental Illness": "family_history",
}
FEATURES = list(RAW_FEATURES.values())
NUMERIC_FEATURES = FEATURES[:5]
TEXT_FEATURES = FEATURES[5:]
RAW_LABEL = "Depression"
LABEL = "depression"

# Survey columns that are never features.
IGNORED_COLUMNS = [
    "id",
    "City",
    "Profession",
    "Dietary Habits",
    "Degree",
    "Have you ever had suicidal thoughts ?",
]

# Code of each sleep answer.
SLEEP_LEVELS = {
    "Less than 5 hours": 0,
    "5-6 hours": 1,
    "7-8 hours": 2,
    "More than 8 hours": 3,
}
# The answers in both survey languages.
GENDER_CODES = {"Male": 1, "Female": 0, "Nam": 1, "Nữ": 0}
FAMILY_CODES = {"Yes": 1, "No": 0, "Có": 1, "Không": 0}
# Lower-case tokens and fragments of the tolerant encoders.
GENDER_TOKENS = ["nam", "male"]
FAMILY_TOKENS = ["có", "yes", "1"]
SLEEP_FRAGMENTS = [
    ("dưới 5", 0.0),
    ("less than 5", 0.0),
    ("5-6", 1.0),
    ("7-8", 2.0),
    ("trên 8", 3.0),
    ("more than 8", 3.0),
]
# Label tokens that mean 1 (case-sensitive).
TRUTHY_LABELS = ["1", "Yes", "yes", "True"]

# Value used when a numeric answer does not parse.
NUMERIC_DEFAULTS = {
    "age": 20.0,
    "cgpa": 3.0,
    "academic_pressure": 3.0,
    "study_satisfaction": 3.0,
    "financial_stress": 3.0,
}
# Value used when a whole column is absent from the file.
ABSENT_COLUMN_DEFAULTS = {
    "Age": "20",
    "CGPA": "3.0",
    "Academic Pressure": "3",
    "Study Satisfaction": "3",
    "Financial Stress": "3",
    "Gender": "Male",
    "Family History of Mental Illness": "No",
    "Sleep Duration": "7-8 hours",
    "Depression": "0",
}

# Noise settings of the perturbed experiment.
JITTER_COLUMNS = ["cgpa", "age", "academic_pressure", "study_satisfaction", "financial_stress"]
JITTER_FACTOR = 0.35
FLIP_RATE = 0.015
SEED = 42
FOLDS = 5

# Forest settings.
FOREST_SETTINGS = {
    "numTrees": 200,
    "maxDepth": 15,
    "minInstancesPerNode": 2,
    "subsamplingRate": 0.8,
    "seed": 42,
}

# The stored logistic parameters, in FEATURES order.
STORED_PARAMETERS = {
    "means": [25.82230027597592, 7.656104171893469, 3.1412135765742963, 2.9438371384538193,
              3.1398666571080174, 1.3999856635962942, 0.5572201713200243, 0.4839611483459374],
    "stds": [4.9056874489243185, 1.4707073462076152, 1.3814648413275956, 1.3611479552669794,
             1.4372694180530003, 1.1270566226320866, 0.49672396279483905, 0.49975164491060287],
    "coefficients": [-0.5194896316619154, 0.07706852205968999, 1.1629950591970708,
                     -0.31538575105126004, 0.8231666853072953, -0.21440012151427795,
                     0.038699031564406676, 0.11953919482763196],
    "intercept": 0.527102115743904,
}
# Parameters used when no parameter file can be read.
FALLBACK_PARAMETERS = {
    "means": [20.0, 3.0, 3.0, 3.0, 3.0, 1.0, 0.5, 0.5],
    "stds": [5.0, 0.5, 1.0, 1.0, 1.0, 1.0, 0.5, 0.5],
    "coefficients": [0.1, -0.5, 0.8, -0.4, 0.6, -0.3, 0.1, 0.5],
    "intercept": -1.5,
}

# Wording and limits of the score and reliability reports.
STATUS_HIGH = "NGUY CƠ CAO"
STATUS_SAFE = "AN TOÀN"
RELIABILITY_TIERS = [
    (0.85, "RẤT CAO (EXCELLENT)"),
    (0.75, "CAO (GOOD)"),
    (0.60, "TRUNG BÌNH (FAIR)"),
]
RELIABILITY_LOWEST = "THẤP (POOR)"
REPLICATES = 50
