"""The BS 5930 vocabulary. Everything below is fixed values, which results depend on."""

# Phrases of several words by class, in the order in which they are tried.
RANGES = ["soft to firm", "firm to stiff", "stiff to very stiff", "very soft to soft"]
PHRASES = {
    "consistency": ["very soft", "very stiff"],
    "density": ["medium dense to dense", "loose to medium dense", "very loose", "very dense", "medium dense"],
    "rock_strength": ["very weak", "moderately weak", "moderately strong", "very strong", "extremely strong"],
    "weathering_grade": ["slightly weathered", "moderately weathered", "highly weathered", "completely weathered"],
    "color": ["dark gray", "dark grey", "light gray", "light grey", "dark brown", "light brown", "reddish brown", "yellowish brown"],
    "plasticity_index": ["non plastic", "non-plastic", "low plasticity", "intermediate plasticity", "high plasticity", "extremely high plasticity"],
    "particle_size": ["fine to medium", "medium to coarse", "fine to coarse"],
}
# Single words by class, in the order that settles ties between equally similar ones.
WORDS = [
    ("consistency", ["soft", "firm", "stiff", "hard"]),
    ("density", ["loose", "dense"]),
    ("rock_strength", ["weak", "strong"]),
    ("weathering_grade", ["fresh", "weathered"]),
    ("rock_structure", ["massive", "bedded", "jointed", "fractured", "foliated", "laminated"]),
    ("proportion", ["slightly", "moderately", "very"]),
    ("soil_type", ["clay", "silt", "sand", "gravel", "cobbles", "boulders", "peat", "organic"]),
    ("rock_type", ["limestone", "sandstone", "mudstone", "shale", "granite", "basalt", "chalk", "dolomite", "quartzite", "slate", "schist", "gneiss", "marble", "conglomerate", "breccia"]),
    ("adjective", ["sandy", "silty", "clayey", "gravelly"]),
    ("color", ["gray", "grey", "brown", "red", "yellow", "orange", "black", "white", "green", "blue", "pink", "purple", "tan", "buff"]),
    ("moisture_content", ["dry", "moist", "wet", "saturated"]),
    ("particle_size", ["fine", "medium", "coarse"]),
]
# Misspellings and the words they stand for.
TYPOS = {
    "firn": "firm", "frim": "firm",
    "stif": "stiff", "stff": "stiff", "sitff": "stiff",
    "soff": "soft", "sfot": "soft",
    "clai": "clay", "caly": "clay",
    "snad": "sand", "sant": "sand",
    "siltt": "silt",
    "garvel": "gravel", "grabel": "gravel", "gravelv": "gravel",
    "limstone": "limestone", "limetone": "limestone", "limesone": "limestone",
    "sandston": "sandstone", "sandstoen": "sandstone",
    "mudston": "mudstone", "mudstoen": "mudstone",
    "granit": "granite", "graniet": "granite",
    "baslt": "basalt",
    "loos": "loose", "losoe": "loose",
    "dens": "dense", "dence": "dense", "dnese": "dense",
    "waek": "weak", "weka": "weak",
    "storng": "strong", "strogn": "strong", "stong": "strong",
    "slighty": "slightly", "slighly": "slightly", "slighlty": "slightly",
    "moderatly": "moderately", "moderatley": "moderately", "modertely": "moderately",
    "snady": "sandy", "sadny": "sandy",
    "claey": "clayey", "clayy": "clayey",
    "gravelley": "gravelly", "gravely": "gravelly",
    "borwn": "brown", "browm": "brown",
    "gery": "gray",
    "weatherd": "weathered", "waethered": "weathered", "wethered": "weathered",
    "massiv": "massive", "masive": "massive",
    "bedde": "bedded",
    "jointe": "jointed",
    "fractued": "fractured", "fracured": "fractured",
    "foliatd": "foliated",
    "laminatd": "laminated",
}
TYPO_SCORE, FUZZY_THRESHOLD = 0.95, 0.80
FUZZY_FIRST, FUZZY_MIN, FUZZY_MAX, FUZZY_SPAN, WORD_BYTES = "bcdfglmoprstwh", 3, 15, 3, 64

ROCK_CLASSES = ["rock_type", "rock_strength", "weathering_grade", "rock_structure"]
COHESIVE, GRANULAR = ["CLAY", "SILT"], ["SAND", "GRAVEL", "COBBLES", "BOULDERS"]
# What a matched text means where that is not itself; None: nothing.
MEANING = {"very soft to soft": None, "weathered": None, "dark grey": "dark gray", "light grey": "light gray", "non-plastic": "non plastic"}
ADJECTIVE = {"sand": "sandy", "silt": "silty", "clay": "clayey", "gravel": "gravelly"}

# Ordinals, from 0.
CONSISTENCY = ["very soft", "soft", "firm", "stiff", "very stiff", "hard", "soft to firm", "firm to stiff", "stiff to very stiff"]
DENSITY = ["very loose", "loose", "loose to medium dense", "medium dense", "medium dense to dense", "dense", "very dense"]
ROCK_STRENGTH = ["very weak", "weak", "moderately weak", "moderately strong", "strong", "very strong", "extremely strong"]
WEATHERING = ["fresh", "slightly weathered", "moderately weathered", "highly weathered", "completely weathered"]

# lower, upper, typical.
CU = {"very soft": (0, 12, 6), "soft": (12, 25, 18), "firm": (25, 50, 37), "stiff": (50, 100, 75), "very stiff": (100, 200, 150), "hard": (200, 400, 300), "soft to firm": (12, 50, 31), "firm to stiff": (25, 100, 62), "stiff to very stiff": (50, 200, 125)}
SPT = {"very loose": (0, 4, 2), "loose": (4, 10, 7), "loose to medium dense": (4, 30, 17), "medium dense": (10, 30, 20), "medium dense to dense": (10, 50, 30), "dense": (30, 50, 40), "very dense": (50, 100, 75)}
UCS = {"very weak": (0.25, 1, 0.6), "weak": (1, 5, 2.5), "moderately weak": (5, 12.5, 8), "moderately strong": (12.5, 50, 25), "strong": (50, 100, 75), "very strong": (100, 200, 150), "extremely strong": (200, 500, 300)}
STRENGTH = {"cu": (CU, "kPa", 0.8), "SPT-N": (SPT, "blows/300mm", 0.75), "UCS": (UCS, "MPa", 0.7)}
# Upper limits of the words of a measured value; the last word has none.
INVERSE = {
    "cu": ([12, 25, 50, 100, 200], ["very soft", "soft", "firm", "stiff", "very stiff", "hard"]),
    "SPT-N": ([4, 10, 30, 50], ["very loose", "loose", "medium dense", "dense", "very dense"]),
    "UCS": ([1, 5, 12.5, 50, 100, 200], ["very weak", "weak", "moderately weak", "moderately strong", "strong", "very strong", "extremely strong"]),
}
PROPORTION = {"slightly": (5, 12, 8), "moderately": (12, 35, 20), "very": (35, 65, 50)}
PROPORTION_LIMITS = ([5, 12, 35, 65], [None, "slightly", "moderately", "very", "predominantly"])

WARNINGS = {
    "rock_with_soil": "Material contains soil types (clay, silt, sand, gravel) but was classified as rock - check descriptors",
    "no_consistency": "Cohesive soil (clay/silt) should have consistency descriptor (very soft, soft, firm, stiff, very stiff, hard)",
    "density_on_cohesive": "Density descriptors (loose, dense) cannot be used with cohesive soils (clay/silt)",
    "no_density": "Granular soil (sand/gravel) should have density descriptor (very loose, loose, medium dense, dense, very dense)",
    "consistency_on_granular": "Consistency descriptors (soft, firm, stiff) cannot be used with granular soils (sand/gravel)",
    "plasticity_on_granular": "Plasticity descriptors should only be used with cohesive soils (clay/silt)",
    "rock_strength_on_soil": "Rock strength descriptors cannot be used with soil materials",
}
SOIL_KEYWORDS = "clay|silt|sand|gravel|peat|organic"

DEPRECATED = [
    ("medium firm", "Use 'firm' or 'firm to stiff'", "BS 5930:2015 §6.3.2.2"), ("moderately stiff", "Use 'stiff' or 'firm to stiff'", "BS 5930:2015 §6.3.2.2"),
    ("quite", "Use standard BS 5930 descriptors", "BS 5930:2015 §6.3"), ("somewhat", "Use standard BS 5930 descriptors", "BS 5930:2015 §6.3"), ("fairly", "Use standard BS 5930 descriptors", "BS 5930:2015 §6.3"),
    ("with sand", "Use 'slightly sandy', 'moderately sandy', or 'very sandy'", "BS 5930:2015 §6.3.2.4"), ("with gravel", "Use 'slightly gravelly', 'moderately gravelly', or 'very gravelly'", "BS 5930:2015 §6.3.2.4"),
    ("containing", "Use BS 5930 proportion descriptors", "BS 5930:2015 §6.3.2.4"), ("traces of", "Use 'slightly' for 5-20%", "BS 5930:2015 §6.3.2.4"),
]
STANDARD = "BS 5930:2015"

# Abbreviations in the order in which they are replaced, as plain substrings.
ABBREVIATIONS = [
    ("v.soft", "very soft"), ("v. soft", "very soft"), ("vs", "very soft"), ("v.stiff", "very stiff"), ("v. stiff", "very stiff"), ("v.s.", "very stiff"),
    ("v.loose", "very loose"), ("v. loose", "very loose"), ("vl", "very loose"), ("med. dense", "medium dense"), ("med dense", "medium dense"), ("md", "medium dense"),
    ("v.dense", "very dense"), ("v. dense", "very dense"), ("vd", "very dense"), ("sl.", "slightly"), ("sl", "slightly"), ("mod.", "moderately"), ("mod", "moderately"), ("v.", "very"), ("v", "very"),
]


def single_words() -> list[tuple[str, str]]:
    """(word, class) in tie order."""
    return [(w, kind) for kind, words in WORDS for w in words]


def phrases() -> list[tuple[str, str]]:
    """(phrase, class) in the order tried."""
    return [(p, "consistency") for p in RANGES] + [(p, kind) for kind, group in PHRASES.items() for p in group]


def typos() -> dict[str, str]:
    return TYPOS
