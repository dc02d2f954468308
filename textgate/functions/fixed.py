"""Fixed values of the checks. Longer tables (routing terms, stop-words, tell phrases) are parameters: see sources.rules."""

# Verbs that anchor collocations.
PHRASE_VERBS = (
    "measured", "obtained", "exhibits", "exhibited", "fabricated", "enhanced", "achieved", "demonstrated", "observed", "estimated",
    "calculated", "deposited", "prepared", "revealed", "confirmed", "indicates", "increased", "decreased", "improved", "showed",
)

# Families of spellings that should not be mixed.
VARIANT_FAMILIES = (
    ("bandgap", "band gap", "band-gap"),
    ("thin film", "thin-film", "thinfilm"),
    ("x-ray", "x ray", "xray"),
    ("in situ", "in-situ"),
    ("ex situ", "ex-situ"),
    ("in vivo", "in-vivo"),
    ("in vitro", "in-vitro"),
    ("et al.", "et al"),
    ("quantum dot", "quantum-dot"),
    ("photonic crystal", "photonic-crystal"),
    ("buildup", "build-up", "build up"),
    ("setup", "set-up", "set up"),
)

# Chemical elements, up to californium.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In "
    "Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf"
).split()

# Acronyms that need no definition, words that aren't acronyms, and words an expansion must not hold.
ACRONYMS_KNOWN = ("DNA", "RNA", "UV")
ACRONYMS_SKIPPED = ("II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "OK", "USA", "OR", "AND", "NOT")
ACRONYM_STOPWORDS = (
    "IN ON AT TO OF AND THE FOR WITH BY PRESS ARTICLE OPEN ACCESS ET AL FIG TAB REF EQ SEC NO DOI HTTP HTTPS URL TEL FAX ORCID "
    "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC VIA PER ETC VS"
).split()
AFFILIATIONS = ("university", "instituto", "institute", "department", "faculty", "school", "laboratory", "centre", "center", "college", "hospital")

# Headings of section roles, in order of precedence.
SECTION_ROLES = {
    "abstract": ("abstract", "summary"),
    "introduction": ("introduction", "background"),
    "methods": ("methods", "method", "materials and methods", "experimental section", "experimental", "methodology"),
    "results": ("results", "findings"),
    "discussion": ("discussion",),
    "conclusion": ("conclusions", "conclusion", "concluding remarks", "summary and outlook", "outlook"),
    "references": ("references", "reference", "bibliography"),
}

# Patterns, as regular expressions of the JVM. W and B are a word character and a word boundary as Unicode has them.
W = r"[\p{L}\p{N}_]"
NOT_BEFORE, NOT_AFTER = rf"(?<!{W})", rf"(?!{W})"
MINING_WORD = r"[A-Za-z][A-Za-z-]{1,}"
BENCH_WORD = r"[A-Za-z][A-Za-z-]*"
SENTENCE_END = r"[.!?]+[\x22\x27)\]]*\s+"
PASSIVE = rf"(?i){NOT_BEFORE}(?:is|are|was|were|be|been|being)\s+(?:{W}+ly\s+)?{W}+(?:ed|en){NOT_AFTER}"
FIRST_PERSON = rf"(?i){NOT_BEFORE}we{NOT_AFTER}"
CITATION_BRACKET = r"\[[\d,\s\-–]+\]"
CITATION_AUTHOR = r"\([A-Z][A-Za-zÀ-ÿ' -]+ et al\.?,? \d{4}[a-z]?\)"
DOI = r"10\.\d{4,}/\S+"
NUMBER = rf"(?<![\p{{L}}\p{{N}}_.])\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![A-Za-z0-9])(?!\.\d)"
UNIT = r"(?:wt%|at%|°C|°K|μM|mM|μL|mL|μm|nm|mm|cm|km|kHz|MHz|GHz|Hz|GPa|MPa|kPa|Pa|kA|mA|kV|mV|kW|mW|kJ|meV|keV|eV|mol|min|rpm|dB|kB|MB|%|[KTAJWVsLhgmN])\d*"
QUANTITY = rf"(?<![\p{{L}}\p{{N}}_.])(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*({UNIT}(?:/{UNIT})?)?"
FORMULA = r"(?<![A-Za-z0-9])(?:[A-Z][a-z]?\d*){2,}(?![A-Za-z0-9])"
FORMULA_PART = r"[A-Z][a-z]?\d*"
HEADING = r"^\s*(?:\d+\.?\d*\.?\s+|[IVX]+\.?\s+)?([A-Za-z][A-Za-z &/-]{1,60}?)\s*$"
ACRONYM = rf"{NOT_BEFORE}([A-Z][A-Za-z0-9]{{1,9}}%?)(?![A-Za-z0-9])"
DEFINED_FORWARD = r"([A-Za-z][A-Za-z -]{2,60}?) \(([A-Z][A-Za-z0-9]{1,9}%?)\)"
DEFINED_REVERSE = rf"{NOT_BEFORE}([A-Z][A-Za-z0-9]{{1,9}}) \(([a-z][A-Za-z -]{{2,60}})\)"
FIGURE = rf"{NOT_BEFORE}(?:Figure|Fig\.)\s+(\d+){NOT_AFTER}"
HEDGES = tuple(rf"(?i){NOT_BEFORE}(?:{x}){NOT_AFTER}" for x in ("may|might|could", "possibly|potentially", "suggest|suggests|appear|appears|seem|seems"))
OVERCLAIM = rf"(?i){NOT_BEFORE}(?:this|these|our)\s+{W}{{0,15}}\s*prove[sd]?{NOT_AFTER}"
FIGURE_PAST = rf"{NOT_BEFORE}(?:Figure|Fig\.|Table)\s+\d+\s+(?:showed|listed|presented|depicted){NOT_AFTER}"
TRANSITION = rf"^\s*(?:Furthermore|Moreover|Additionally|In addition|Also|Nevertheless|Nonetheless){NOT_AFTER}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
LICENCE_URL = r"(?i)creativecommons\.org/licenses/(by[a-z-]*)/(\d\.\d)"
LICENCE_TEXT = r"(?i)Creative Commons Attribution([ -][A-Za-z-]+?)? (\d\.\d)(?: International)? License"
EQUAL_SIGNS, JOIN_SIGNS = "=≈≃∝", "+−‑×·±*/"
MATH_SIGNS = "αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ√∫∂⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₔₕₖₗₘₙₚₛₜ"

# Thresholds and weights.
LEVELS = {"low": (0.10, 0.30), "mid": (0.20, 0.50), "high": (0.30, 0.50)}
WARN_RATE, STOP_RATE = 0.30, 0.50
SEVERITY_WEIGHTS = {"minor": 1.0, "major": 2.0, "critical": 4.0}
MATURE_FILES, MATURE_WORDS = 10, 100_000
COVERAGE = {"papers": (25.0, 20), "collocations": (25.0, 20), "sections": (15.0, 5), "words": (15.0, 100_000)}
STABILITY_WEIGHT, NEUTRAL_OVERLAP = 20.0, 0.5
BOOTSTRAP_SEED, BOOTSTRAP_REPLICATES = 20260805, 10_000
EDIT_CLASSES = ("articles", "agreement/countability", "section-tense", "korean-translationese", "field-terminology", "claim-calibration", "none")
ORIGINS, REVIEWS = ("natural", "synthetic"), ("pending", "approved")
