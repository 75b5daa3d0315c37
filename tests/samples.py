"""Eleven labels with their applications and the verdict that each should get, and the statement as lines."""

from proofmark.functions.constants import STATEMENT

BODY = STATEMENT.removeprefix("GOVERNMENT WARNING: ")
ALTERED = "(1) According to the Surgeon General, women should limit alcoholic beverages during pregnancy. (2) Consumption of alcoholic beverages may impair your ability to drive a car."
OLD_TOM = ("Old Tom Distillery", "Kentucky Straight Bourbon Whiskey", "45% Alc./Vol. (90 Proof)", "750 mL", "Old Tom Distillery, Bardstown, Kentucky", "")
OLD_TOM_LABEL = ("OLD TOM DISTILLERY", "Kentucky Straight Bourbon Whiskey", "", "45% Alc./Vol. (90 Proof)", "750 mL", "Distilled and Bottled by Old Tom Distillery, Bardstown, Kentucky")

# name, application, label (brand, class, origin, alcohol, volume, bottler), heading, body, heading is bold, tilt, verdict
SAMPLES = [
    ("old_tom_bourbon.png", OLD_TOM, OLD_TOM_LABEL, "GOVERNMENT WARNING:", BODY, True, 0.0, "pass"),
    ("stones_throw_gin.png", ("Stone's Throw", "London Dry Gin", "47%", "75 cL", "Stone's Throw Spirits, Portland, Oregon", ""), ("STONE'S THROW", "London Dry Gin", "", "47% Alc./Vol. (94 Proof)", "750 mL", "Bottled by Stone's Throw Spirits, Portland, Oregon"), "GOVERNMENT WARNING:", BODY, True, 0.0, "pass"),
    ("old_tom_wrong_abv.png", OLD_TOM, (*OLD_TOM_LABEL[:3], "40% Alc./Vol. (80 Proof)", *OLD_TOM_LABEL[4:]), "GOVERNMENT WARNING:", BODY, True, 0.0, "fail"),
    ("silver_creek_titlecase_warning.png", ("Silver Creek", "Vodka", "40% Alc./Vol. (80 Proof)", "1 L", "Silver Creek Spirits, Boise, Idaho", ""), ("SILVER CREEK", "Vodka", "", "40% Alc./Vol. (80 Proof)", "1 L", "Bottled by Silver Creek Spirits, Boise, Idaho"), "Government Warning:", BODY, True, 0.0, "fail"),
    ("harbor_light_missing_warning.png", ("Harbor Light", "India Pale Ale", "6.8%", "12 fl oz", "Harbor Light Brewing Co., Portland, Maine", ""), ("HARBOR LIGHT", "India Pale Ale", "", "6.8% Alc./Vol.", "12 FL OZ", "Brewed and Bottled by Harbor Light Brewing Co., Portland, Maine"), "", "", True, 0.0, "fail"),
    ("red_mesa_altered_warning.png", ("Red Mesa", "Tequila Reposado", "40% Alc./Vol. (80 Proof)", "750 mL", "Red Mesa Imports, San Antonio, Texas", "Mexico"), ("RED MESA", "Tequila Reposado", "PRODUCT OF MEXICO", "40% Alc./Vol. (80 Proof)", "750 mL", "Imported by Red Mesa Imports, San Antonio, Texas"), "GOVERNMENT WARNING:", ALTERED, True, 0.0, "fail"),
    ("chateau_lumiere_wine.png", ("Chateau Lumiere", "Red Bordeaux Wine", "13.5%", "750 mL", "Lumiere Wine Imports, New York, New York", "France"), ("CHATEAU LUMIERE", "Red Bordeaux Wine", "PRODUCT OF FRANCE", "13.5% Alc./Vol.", "750 mL", "Imported by Lumiere Wine Imports, New York, New York"), "GOVERNMENT WARNING:", BODY, True, 0.0, "pass"),
    ("old_tom_photo.jpg", OLD_TOM, OLD_TOM_LABEL, "GOVERNMENT WARNING:", BODY, True, 5.0, "pass"),
    ("north_fork_plain_warning.png", ("North Fork", "Straight Rye Whiskey", "50% Alc./Vol. (100 Proof)", "750 mL", "North Fork Distilling, Bozeman, Montana", ""), ("NORTH FORK", "Straight Rye Whiskey", "", "50% Alc./Vol. (100 Proof)", "750 mL", "Distilled and Bottled by North Fork Distilling, Bozeman, Montana"), "GOVERNMENT WARNING:", BODY, False, 0.0, "review"),
    ("blue_herron_brand_typo.png", ("Blue Heron", "Small Batch Rum", "42% Alc./Vol. (84 Proof)", "750 mL", "Blue Heron Rum Company, Charleston, South Carolina", ""), ("BLUE HERRON", "Small Batch Rum", "", "42% Alc./Vol. (84 Proof)", "750 mL", "Bottled by Blue Heron Rum Company, Charleston, South Carolina"), "GOVERNMENT WARNING:", BODY, True, 0.0, "review"),
    ("glen_cairn_british_spelling.png", ("Glen Cairn", "Honey Flavored Whiskey Liqueur", "35% Alc./Vol. (70 Proof)", "700 mL", "Glen Cairn Imports, Boston, Massachusetts", "Scotland"), ("GLEN CAIRN", "Honey Flavoured Whisky Liqueur", "PRODUCT OF SCOTLAND", "35% Alc./Vol. (70 Proof)", "700 mL", "Imported by Glen Cairn Imports, Boston, Massachusetts"), "GOVERNMENT WARNING:", BODY, True, 0.0, "pass"),
]


def wrapped(text: str, width: int = 60) -> list[str]:
    out: list[str] = []
    for word in text.split():
        if out and len(out[-1]) + 1 + len(word) <= width:
            out[-1] += " " + word
        else:
            out.append(word)
    return out


def box(x: float, y: float, width: float, height: float, degrees: float) -> list[tuple[float, float]]:
    from math import cos, radians, sin

    turn = lambda a, b: (a * cos(radians(degrees)) - b * sin(radians(degrees)), a * sin(radians(degrees)) + b * cos(radians(degrees)))
    return [turn(x, y), turn(x + width, y), turn(x + width, y + height), turn(x, y + height)]


def sample_lines() -> list[tuple]:
    """Lines out of order, alcohol and volume side by side."""
    rows = []
    for name, _, label, heading, body, _, tilt, _ in SAMPLES:
        brand, kind, origin, alcohol, volume, bottler = label
        placed = [(brand, 0, 0), (kind, 0, 100), (origin, 0, 200), (alcohol, 0, 300), (volume, 600, 302), (bottler, 0, 400)]
        placed += [(t, 0, 500 + 50 * k) for k, t in enumerate(wrapped(f"{heading} {body}"))]
        rows += [(name, k, text, 0.95, box(x, y, 12.0 * len(text), 30, tilt)) for k, (text, x, y) in enumerate(reversed(placed)) if text.strip()]
    return rows
