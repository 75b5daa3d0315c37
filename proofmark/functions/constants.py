"""Limits, the required statement, spellings, units, titles and the words shown for codes."""

# Fixed values that results have to agree on, in their given order.
MIN_CONFIDENCE, MIN_CHARACTERS = 0.6, 15
REVIEW_SCORE, HEADING_SCORE, MOST_CLOSE_SCORE = 80.0, 85.0, 99.9
MISREAD_CHARACTERS, MISREAD_CAPITALS = 4, 2
WINDOW_FACTOR = 1.5
ALCOHOL_CONTEXT = 15
VOLUME_TOLERANCE = 0.01
BOLD_RATIO = 1.25
SAME_ROW = 0.6
MAX_IMAGE_BYTES = 15 * 1024 * 1024

HEADING = "GOVERNMENT WARNING"
STATEMENT = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during "
    "pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to "
    "drive a car or operate machinery, and may cause health problems."
)
STATEMENT_END = "health problems"

SPELLINGS = (
    ("colour", "color"), ("flavour", "flavor"), ("favour", "favor"), ("honour", "honor"), ("harbour", "harbor"),
    ("labour", "labor"), ("neighbour", "neighbor"), ("savour", "savor"), ("litre", "liter"), ("centre", "center"),
    ("fibre", "fiber"), ("grey", "gray"), ("whiskey", "whisky"), ("draught", "draft"), ("sulph", "sulf"),
    ("ageing", "aging"), ("mould", "mold"), ("yoghurt", "yogurt"), ("licence", "license"), ("speciality", "specialty"),
    ("aluminium", "aluminum"), ("pasteuris", "pasteuriz"), ("caramelis", "carameliz"), ("carbonis", "carboniz"),
    ("organis", "organiz"), ("recognis", "recogniz"),
)

UNITS = (
    ("ml|millilit(?:er|re)s?", 1.0),
    ("cl|centilit(?:er|re)s?", 10.0),
    (r"fl\.?\s*oz\.?|fluid\s*ounces?|oz\.?", 29.5735),
    (r"pints?|pt\.?", 473.176),
    (r"quarts?|qt\.?", 946.353),
    (r"gallons?|gal\.?", 3785.41),
    ("lit(?:er|re)s?|l", 1000.0),
)

# What counts as a number, a proof and a volume in a text. White space and digits are Unicode's.
NUMBER = r"(\d{1,3}(?:[.,]\d{1,2})?)"
PROOF = r"(\d{2,3}(?:\.\d+)?)[\s\x1C-\x1F]*proof"
QUANTITY = r"(?<![\d.,])(\d+(?:[.,]\d+)?)[\s\x1C-\x1F]*(" + "|".join(u for u, _ in UNITS) + ")(?![a-z])"
ALCOHOL_WORDS = "alc|vol|abv"

TITLES = {
    "brand_name": "Brand name",
    "class_type": "Class / type",
    "alcohol_content": "Alcohol content",
    "net_contents": "Net contents",
    "bottler": "Bottler / producer",
    "country_of_origin": "Country of origin",
    "warning_wording": "Government warning wording",
    "warning_capitals": "Warning heading in capitals",
    "warning_bold": "Warning heading in bold",
}
TEXT_FIELDS = ("brand_name", "class_type", "bottler", "country_of_origin")
APPLICATION_FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler", "country_of_origin")
STATUSES = ("mismatch", "not_found", "review", "match")
BUCKETS = ("fail", "review", "pass")
SHOWN = {
    "pass": "Label matches the application",
    "review": "Needs a closer look",
    "fail": "Problems found",
    "unreadable": "Could not read the label",
}
SHOWN_STATUS = {"match": "Matches", "review": "Check by eye", "mismatch": "Does not match", "not_found": "Not found"}
UNREADABLE_SUMMARY = "The label could not be read clearly. Ask for a better image."
PASS_SUMMARY = "Everything on the label matches the application."
