"""Labels to evaluate the classifier on."""

# Fixed values: (label, bucket, subtype or None where none is asked for, least confidence).
CASES = [
    ("CAM", "cams", "cam", 0.9),
    ("C.A.M.", "cams", "cam", 0.9),
    ("c.a.m.s", "cams", "cam", 0.9),
    ("CAMS", "cams", "cam", 0.9),
    ("Common Area Maintenance", "cams", "common_area_maintenance", 0.9),
    ("common area maintenance charges", "cams", "common_area_maintenance", 0.9),
    ("operating expenses", "cams", "operating_expenses", 0.9),
    ("operating cost recovery", "cams", "operating_cost_recovery", 0.9),
    ("building expenses", "cams", "operating_expenses", 0.9),
    ("cam fee", "cams", "cam", 0.9),
    ("OpEx", "cams", "operating_expenses", 0.9),
    ("operating cost reimbursement", "cams", "operating_cost_recovery", 0.9),
    ("common area malntenance", "cams", "common_area_maintenance", 0.85),
    ("operatlng expenses", "cams", "operating_expenses", 0.85),
    ("c0mmon area ma1ntenance", "cams", None, 0.65),
    ("0perating expenses", "cams", None, 0.65),
    ("nnn", "cams", "nnn_composite", 0.9),
    ("N.N.N.", "cams", "nnn_composite", 0.9),
    ("triple net", "cams", "nnn_composite", 0.9),
    ("trlple net", "cams", "nnn_composite", 0.8),
    ("net charges", "cams", "nnn_composite", 0.9),
    ("additional rent", "cams", "nnn_composite", 0.9),
    ("Triple Net Charges", "cams", "nnn_composite", 0.9),
    ("net net net", "cams", "nnn_composite", 0.9),
    ("triple net rent", "cams", "nnn_composite", 0.7),
    ("insurance", "insurance", "property_insurance", 0.9),
    ("property insurance", "insurance", "property_insurance", 0.9),
    ("casualty insurance", "insurance", "casualty_insurance", 0.9),
    ("hazard insurance", "insurance", "hazard_insurance", 0.9),
    ("fire insurance", "insurance", "property_insurance", 0.9),
    ("insurance premium", "insurance", "property_insurance", 0.9),
    ("insuranee", "insurance", "property_insurance", 0.85),
    ("real estate taxes", "taxes", "real_estate_taxes", 0.9),
    ("property taxes", "taxes", "real_estate_taxes", 0.9),
    ("property tax", "taxes", "real_estate_taxes", 0.9),
    ("ad valorem taxes", "taxes", "ad_valorem_taxes", 0.9),
    ("ad valorem", "taxes", "ad_valorem_taxes", 0.9),
    ("assessments", "taxes", "assessments", 0.9),
    ("special assessments", "taxes", "assessments", 0.9),
    ("r.e. taxes", "taxes", "real_estate_taxes", 0.7),
    ("rea1 estate taxe5", "taxes", "real_estate_taxes", 0.65),
    ("ad valorem tax", "taxes", "ad_valorem_taxes", 0.9),
    ("security", "security", "security_service", 0.9),
    ("security patrol", "security", "guard_patrol", 0.9),
    ("guard service", "security", "guard_patrol", 0.9),
    ("guard patrol", "security", "guard_patrol", 0.9),
    ("securlty", "security", "security_service", 0.85),
    ("admin fee", "otherItems", "administrative_fee", 0.9),
    ("administrative fee", "otherItems", "administrative_fee", 0.9),
    ("general admin", "otherItems", "general_admin_fee", 0.9),
    ("general admin fee", "otherItems", "general_admin_fee", 0.9),
    ("management fee", "otherItems", "management_fee", 0.9),
    ("property management fee", "otherItems", "management_fee", 0.9),
    ("janitorial", "otherItems", "janitorial", 0.9),
    ("landscaping", "otherItems", "landscaping", 0.9),
    ("hvac maintenance", "otherItems", "hvac_maintenance", 0.9),
    ("water", "otherItems", "water", 0.9),
    ("sewer", "otherItems", "sewer", 0.9),
    ("water/sewer", "otherItems", "water_sewer", 0.9),
    ("trash removal", "otherItems", "trash", 0.9),
    ("refuse removal", "otherItems", "trash", 0.9),
    ("utllities", "otherItems", "utilities", 0.85),
    ("janitoral", "otherItems", "janitorial", 0.85),
    ("g3nera*** admin f55", "otherItems", None, 0.5),
    ("maintenance charge", "cams", "common_area_maintenance", 0.65),
    ("service fee", "otherItems", "service_fee", 0.9),
    ("additional charge", "otherItems", None, 0.2),
    ("expense reimbursement", "otherItems", None, 0.2),
    ("general maintenance", "otherItems", None, 0.2),
    ("elevator maintenance", "otherItems", "elevator_maintenance", 0.9),
    ("grounds maintenance", "otherItems", "landscaping", 0.9),
    ("liability insurance", "insurance", "property_insurance", 0.9),
]
