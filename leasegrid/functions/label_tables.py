"""Fixed values of the expense-label classifier: phrases, weights, corrections and thresholds."""

from __future__ import annotations

BUCKETS = ["cams", "insurance", "taxes", "security", "otherItems"]
FUZZY, TOKEN, RESCUE, AMBIGUOUS, SUBTYPE = 0.72, 1.5, 0.75, 0.6, 0.5

# Fixed values: (phrase, bucket, subtype). Order decides ties.
PHRASES = [
    ("cam", "cams", "cam"), ("cams", "cams", "cam"), ("cam charges", "cams", "cam"), ("cam fee", "cams", "cam"),
    ("common area maintenance", "cams", "common_area_maintenance"), ("common area maintenance charges", "cams", "common_area_maintenance"),
    ("common area costs", "cams", "common_area_maintenance"), ("common area expenses", "cams", "common_area_maintenance"),
    ("common area fees", "cams", "common_area_maintenance"),
    ("operating expenses", "cams", "operating_expenses"), ("operating expense", "cams", "operating_expenses"), ("operating costs", "cams", "operating_expenses"),
    ("operating cost", "cams", "operating_expenses"),
    ("operating cost recovery", "cams", "operating_cost_recovery"), ("operating cost reimbursement", "cams", "operating_cost_recovery"),
    ("operating expense recovery", "cams", "operating_cost_recovery"),
    ("building expenses", "cams", "operating_expenses"), ("building expense", "cams", "operating_expenses"), ("project expenses", "cams", "operating_expenses"),
    ("maintenance charges", "cams", "common_area_maintenance"), ("maintenance fees", "cams", "common_area_maintenance"),
    ("nnn", "cams", "nnn_composite"), ("nnn rent", "cams", "nnn_composite"), ("triple net", "cams", "nnn_composite"), ("net charges", "cams", "nnn_composite"),
    ("net operating charges", "cams", "nnn_composite"), ("additional rent", "cams", "nnn_composite"), ("base year costs", "cams", "nnn_composite"),
    ("insurance", "insurance", "property_insurance"), ("property insurance", "insurance", "property_insurance"),
    ("hazard insurance", "insurance", "hazard_insurance"),
    ("casualty insurance", "insurance", "casualty_insurance"),
    ("fire insurance", "insurance", "property_insurance"),
    ("property and casualty", "insurance", "casualty_insurance"),
    ("insurance premium", "insurance", "property_insurance"), ("insurance premiums", "insurance", "property_insurance"),
    ("liability insurance", "insurance", "property_insurance"), ("building insurance", "insurance", "property_insurance"),
    ("taxes", "taxes", "real_estate_taxes"), ("tax", "taxes", "real_estate_taxes"), ("real estate taxes", "taxes", "real_estate_taxes"),
    ("real estate tax", "taxes", "real_estate_taxes"), ("property taxes", "taxes", "real_estate_taxes"), ("property tax", "taxes", "real_estate_taxes"),
    ("ad valorem taxes", "taxes", "ad_valorem_taxes"), ("ad valorem tax", "taxes", "ad_valorem_taxes"), ("ad valorem", "taxes", "ad_valorem_taxes"),
    ("assessments", "taxes", "assessments"), ("assessment", "taxes", "assessments"), ("special assessments", "taxes", "assessments"),
    ("special assessment", "taxes", "assessments"), ("tax assessment", "taxes", "assessments"),
    ("security", "security", "security_service"), ("security service", "security", "security_service"), ("security services", "security", "security_service"),
    ("security charges", "security", "security_service"),
    ("patrol", "security", "guard_patrol"), ("guard service", "security", "guard_patrol"), ("guard services", "security", "guard_patrol"),
    ("guard patrol", "security", "guard_patrol"), ("security patrol", "security", "guard_patrol"), ("security guard", "security", "guard_patrol"),
    ("general admin fee", "otherItems", "general_admin_fee"), ("general admin fees", "otherItems", "general_admin_fee"),
    ("general admin", "otherItems", "general_admin_fee"), ("general administrative fee", "otherItems", "general_admin_fee"),
    ("general administrative fees", "otherItems", "general_admin_fee"),
    ("administrative fee", "otherItems", "administrative_fee"), ("administrative fees", "otherItems", "administrative_fee"),
    ("admin fee", "otherItems", "administrative_fee"), ("admin fees", "otherItems", "administrative_fee"), ("administration fee", "otherItems", "administrative_fee"),
    ("management fee", "otherItems", "management_fee"), ("management fees", "otherItems", "management_fee"), ("property management fee", "otherItems", "management_fee"),
    ("property management fees", "otherItems", "management_fee"),
    ("service fee", "otherItems", "service_fee"), ("service fees", "otherItems", "service_fee"),
    ("utilities", "otherItems", "utilities"), ("utility", "otherItems", "utilities"), ("utility charges", "otherItems", "utilities"),
    ("trash", "otherItems", "trash"), ("trash removal", "otherItems", "trash"), ("trash collection", "otherItems", "trash"), ("refuse", "otherItems", "trash"),
    ("refuse removal", "otherItems", "trash"), ("garbage", "otherItems", "trash"),
    ("janitorial", "otherItems", "janitorial"), ("janitorial services", "otherItems", "janitorial"), ("janitorial service", "otherItems", "janitorial"),
    ("cleaning", "otherItems", "janitorial"), ("cleaning services", "otherItems", "janitorial"),
    ("landscaping", "otherItems", "landscaping"), ("grounds maintenance", "otherItems", "landscaping"), ("grounds keeping", "otherItems", "landscaping"),
    ("grounds care", "otherItems", "landscaping"),
    ("hvac maintenance", "otherItems", "hvac_maintenance"), ("hvac", "otherItems", "hvac_maintenance"), ("heating ventilation", "otherItems", "hvac_maintenance"),
    ("water", "otherItems", "water"),
    ("sewer", "otherItems", "sewer"),
    ("water sewer", "otherItems", "water_sewer"), ("water and sewer", "otherItems", "water_sewer"), ("water sewer charges", "otherItems", "water_sewer"),
    ("elevator maintenance", "otherItems", "elevator_maintenance"), ("elevator", "otherItems", "elevator_maintenance"),
    ("elevator service", "otherItems", "elevator_maintenance"),
]

# Weights of words and phrases that count for a bucket.
WEIGHTS = {
    "cams": [
        ("cam", 3.0), ("cams", 3.0), ("common area", 3.0), ("common", 1.5), ("operating", 1.5), ("maintenance", 0.8), ("building expense", 1.5), ("project expense", 1.5),
        ("recovery", 0.5), ("reimbursement", 0.5), ("charges", 0.2),
    ],
    "insurance": [
        ("insurance", 3.0), ("premium", 2.5), ("casualty", 2.5), ("hazard", 2.5), ("fire", 1.2), ("coverage", 1.5), ("liability", 1.5),
    ],
    "taxes": [
        ("tax", 3.0), ("taxes", 3.0), ("ad valorem", 3.0), ("assessment", 2.5), ("assessments", 2.5), ("levy", 2.0), ("real estate", 2.0), ("property", 0.5),
    ],
    "security": [
        ("security", 3.0), ("guard", 3.0), ("patrol", 3.0), ("surveillance", 2.0),
    ],
    "otherItems": [
        ("admin", 2.0), ("administrative", 2.0), ("management fee", 2.5), ("janitorial", 3.0), ("landscaping", 3.0), ("utilities", 3.0), ("utility", 3.0), ("hvac", 3.0),
        ("trash", 3.0), ("refuse", 2.5), ("garbage", 2.5), ("water", 2.0), ("sewer", 2.0), ("elevator", 2.5), ("cleaning", 2.0), ("grounds", 1.5), ("service", 0.4),
        ("fee", 0.4),
    ],
}

# Misread words and what they stand for.
CORRECTIONS = {
    "operatlng": "operating", "malntenance": "maintenance", "maintenancee": "maintenance", "maintenence": "maintenance", "maintenonce": "maintenance",
    "insuranee": "insurance", "lnsurance": "insurance", "insur ance": "insurance", "insuronce": "insurance", "trlple": "triple", "tripe": "triple",
    "securlty": "security", "securi ty": "security", "securtiy": "security", "utllities": "utilities", "utiltties": "utilities", "utilitiees": "utilities",
    "utiltiies": "utilities", "utillties": "utilities", "adm1n": "admin", "administratlve": "administrative", "asses5ments": "assessments",
    "asses5ment": "assessment", "assessements": "assessments", "taxe5": "taxes", "cammon": "common", "comman": "common", "expens5": "expenses",
    "expenes": "expenses", "expence": "expense", "expences": "expenses", "propert y": "property", "reat": "real", "rea1": "real", "esta te": "estate",
    "estote": "estate", "hazord": "hazard", "lancscaping": "landscaping", "landcsaping": "landscaping", "elevato r": "elevator", "hvoc": "hvac",
    "janitoral": "janitorial", "janitorial ": "janitorial", "manogement": "management", "managment": "management", "managemen t": "management", "servlce": "service",
}

# Words that a damaged token may be rescued to, and the digits that stand for letters.
VOCABULARY = (
    "common area maintenance operating expense expenses cost costs real estate taxes tax insurance property cam cams security service guard patrol admin "
    "administrative general management fee utilities utility trash removal refuse janitorial landscaping grounds hvac water sewer elevator triple net nnn "
    "charges additional rent casualty hazard fire premium ad valorem assessment assessments building project recovery reimbursement special services coverage liability"
).split()
DIGITS = [("0", "o"), ("1", "l"), ("1", "i"), ("3", "e"), ("5", "s"), ("5", "e"), ("4", "a"), ("6", "g"), ("8", "b"), ("2", "z")]

# Rewrites of abbreviations, in order.
ABBREVIATIONS = [
    (r"c\.a\.m\.s?", "cams"), (r"n\.n\.n\.", "nnn"), (r"r\.e\.(\s*tax(es)?)", "real estate tax$1"), (r"r\.e\.\s*$", "real estate"),
    (r"water\s*/\s*sewer", "water sewer"), (r"/", " "), (r"-+", " "), (r"\bop\s*ex\b", "operating expenses"), (r"\bop\s*expenses\b", "operating expenses"),
    (r"\bcam\s+charges?\b", "cam"), (r"\bnnn\s+charges?\b", "nnn"), (r"\btriple\s+net\s+charges?\b", "nnn"), (r"\btriple\s+net\b", "nnn"), (r"\bnet\s+net\s+net\b", "nnn"),
]
PUNCTUATION = [(r"[—–…]+", " "), (r"\(.*?\)", " "), (r"[,;:]+", " "), (r"\.+", " ")]
