"""Word lists, code tables and patterns that results depend on. Kept as plain text in natural order."""

# --- fixed values: frequency codes and evidence codes ---
FREQUENCY_TERMS = {"HP:0040280": 1.0, "HP:0040281": 0.9, "HP:0040282": 0.55, "HP:0040283": 0.17, "HP:0040284": 0.02,
                   "HP:0040285": 0.0}
EVIDENCE_CONFIDENCE = {"PCS": 0.95, "TAS": 0.85, "IEA": 0.7}
CAUSAL_TYPES = ("Disease-causing", "Major susceptibility")

# --- fixed values: variant classes and review stars ---
PATHOGENIC = ["Pathogenic", "Likely pathogenic", "Pathogenic/Likely pathogenic"]
BENIGN = ["Benign", "Likely benign", "Benign/Likely benign"]
REVIEW_STARS = {"practice guideline": 4, "reviewed by expert panel": 3,
                "criteria provided, multiple submitters, no conflicts": 2, "criteria provided, single submitter": 1,
                "criteria provided, conflicting classifications": 1}
STAR_CONFIDENCE = {1: 0.7, 2: 0.8, 3: 0.9, 4: 0.95}

# --- fixed values: country names and state codes ---
COUNTRY_ALIASES = {
    "usa": "usa", "u s a": "usa", "united states": "usa", "united states of america": "usa", "us": "usa", "uk": "uk",
    "united kingdom": "uk", "england": "uk", "scotland": "uk", "wales": "uk", "the netherlands": "netherlands",
    "holland": "netherlands", "p r china": "china", "pr china": "china", "people s republic of china": "china",
    "republic of korea": "south korea", "korea": "south korea", "deutschland": "germany", "brasil": "brazil",
    "espana": "spain"}
US_STATES = ("ny ca ma md pa nc oh tx mn il wa mi ga fl ct mo tn wi co va ut nj or az ia in ky la al sc ok ne ks ri nh "
             "de").split()

# --- fixed values: wording of null or negative results ---
NEGATIVE_TITLE = (
    r"\bno (significant |statistically significant )?(benefit|effect|improvement|difference|efficacy)|"
    r"\bfail(ed|ure to)\b|\bnegative (result|trial|study|finding)|\black of (efficacy|benefit|effect|response)|"
    r"\bineffective|\bfutil|\bnot (effective|beneficial)|\bwithout (clinical )?(benefit|improvement)")
NEGATIVE_ABSTRACT = (
    r"did not (significantly )?(improve|reduce|differ|prevent|slow|show)|"
    r"no (statistically )?significant (difference|benefit|improvement|effect|change)|"
    r"failed to (improve|show|demonstrate|prevent|slow)|lack of (efficacy|benefit|clinical benefit)|"
    r"not (clinically )?(effective|beneficial)|ineffective|\bfutil")

# --- fixed values: why a study stopped ---
STOPPED = ["TERMINATED", "WITHDRAWN", "SUSPENDED"]
STOP_BENIGN = (r"objective(s)? (was |were )?(achieved|met|reached)|achieved|study completed|completed as planned|"
               r"business decision|administrative")
STOP_SAFETY = (r"efficacy|futil|safety|adverse|toxic|no benefit|lack of (effect|benefit|response|efficacy)|ineffective|"
               r"not effective|death|serious|interim analysis|endpoint|did not (meet|show)")

# --- fixed values: paper types ---
RETRACTED_TYPES = ["Retracted Publication", "Retraction of Publication"]
COMMENT_TYPES = ["Comment", "Editorial", "Published Erratum", "Expression of Concern"]

# --- fixed values: treatment modalities and model systems ---
MODALITIES = {
    "haematopoietic stem cell transplant": r"stem cell|transplant|hsct|cord blood|bone marrow|\bbmt\b",
    "gene therapy": r"gene therapy|lentivir|\baav\b|autologous cd34|gene transfer|transduced",
    "enzyme replacement therapy": r"enzyme replacement|\bert\b|alfa\b|alfa |\balglucosidase|agalsidase|imiglucerase",
    "substrate reduction therapy": r"substrate reduction|miglustat|eliglustat|venglustat|lucerastat",
    "newborn screening": r"newborn screening|neonatal screening",
    "natural history / registry": r"natural history|registry",
    "biomarker study": r"biomarker",
}
MODEL_SYSTEM = (r"\b(mouse|mice|murine|zebrafish|drosophila|canine|dog|feline|cat|ovine|sheep|bovine|porcine|pig|rat|"
                r"knock-?out|knock-?in|animal model|disease model|ipsc|organoid|cell model|model of)\b")

# --- fixed values: independent source families ---
SOURCE_FAMILIES = ["Orphanet", "HPO", "OMIM", "MONDO", "Reactome", "ClinicalTrials.gov", "PubMed", "PubTator", "MeSH",
                   "NIH RePORTER", "ClinVar", "Curated patient-organisation"]

# --- fixed values: organisation and official names ---
ORG_INCLUDE = (r"foundation|society|association|alliance|network|fund\b|hope|battle|connect|parents|famil|support|"
               r"coalition|charity|trust fund|advocacy")
ORG_EXCLUDE = (r"nhs|trust$|hospital|universit|institut|fundaci|fondazione|irccs|clinic|science foundation|"
               r"research foundation for|dairy|society of|competence network|eurobloodnet|kidney association|"
               r"national science|schizophrenia|eye center|medical|health network|cancer|oncolog|health system|"
               r"ministry|council|gynaec")
BAD_OFFICIAL = (r"\d|xx|director|monitor|clinical|trial|sponsor|medical|study|call|center|centre|information|contact|"
                r"department|global|lead|program|team|research")
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "md", "phd"]
GENERIC_INSTITUTION_WORDS = ["university", "hospital", "medical", "center", "centre", "institute", "school"]
AMBIGUOUS_SYMBOLS = ["APOE", "GRN", "GNE", "TRIM37", "SCP2", "KCTD7", "CAT"]

# --- fixed values: link templates by id prefix (prefix, characters dropped, before, after) ---
URL_TEMPLATES = [
    ("PMID:", 5, "https://pubmed.ncbi.nlm.nih.gov/", "/"),
    ("NCT", 0, "https://clinicaltrials.gov/study/", ""),
    ("VariationID:", 12, "https://www.ncbi.nlm.nih.gov/clinvar/variation/", "/"),
    ("OMIM:", 5, "https://omim.org/entry/", ""),
    ("ORPHA:", 6, "https://www.orpha.net/en/disease/detail/", ""),
    ("R-HSA", 0, "https://reactome.org/content/detail/", ""),
    ("MONDO:", 0, "https://monarchinitiative.org/", ""),
    ("HP:", 0, "https://hpo.jax.org/browse/term/", ""),
    ("http", 0, "", ""),
]

# --- fixed values: stop words of sentence attribution and of snippets ---
CONTENT_STOP = (
    "a an the of in on for to and or is are was were be been with by from at as that this these those it its into about "
    "can could may might also has have had not no than then so such which who what when where how there their they them "
    "he she his her patients patient disease diseases study studies shown showed found other some more most many used "
    "use using including include includes like well been being both each after before during while however therefore "
    "additionally overall").split()
SNIPPET_STOP = (
    "a an the of in on for to and or is are was were be been with by from at as that this these those what which who "
    "whom whose how why when where does do did can could should would may might there their it its into about any all "
    "have has had not no than then so such vs versus").split()

# --- fixed values: statements of a limitation need no citation ---
LIMITATION = (
    r"\b(?:not (?:clear|known|reported|described|covered|addressed|mentioned|available|established)|unknown|unclear|"
    r"no (?:data|information|evidence|studies)|do(?:es)? not (?:say|report|describe|address|mention|cover|provide|"
    r"include|state)|(?:remains?|is) (?:uncertain|unclear|unknown)|more research|further (?:research|studies)|"
    r"talk (?:to|with) (?:a|your) (?:doctor|specialist)|consult)")
HEDGE = (r"\b(no|not|only|may|might|could|unclear|unknown|missing|lack|little|so far|weak|ask|contact|talk|check|share|"
         r"consider|question|care team|lead|yet|uncertain|whether)\b")
NEGATION = r"\b(no|not|only|without|none|never|weak|weakly|missing|unknown)\b"
NOT_AVAILABLE = "ANSWER_NOT_AVAILABLE"

# --- fixed values: everyday words that need no support in the facts ---
COMMON_WORDS = (
    "the this that these those and for with from have has had are was were been will would should could may might can not "
    "but also than then they them their there here what which who whom whose when where while about into over under "
    "more most some any all each both either other another such same very much many few less least only just still even "
    "yes lead research leads family families doctor doctors disease diseases symptom symptoms patient patients group groups "
    "genes gene study studies paper papers care team week contact share ask check treatment therapy medical advice database "
    "information evidence data link links linked linking found finding findings suggests suggest appears appear researchers "
    "researcher clinic clinics specialist specialists organisation organisations support supports published similar "
    "similarity score scale overall different differ differs still listed listing include includes including atlas answer "
    "short uncertain help this word words people person based means mean good question questions possible possibly likely "
    "unlikely important useful helpful learn learning place places step steps start before after because since though "
    "although however therefore otherwise instead unless until").split()
SECTION_LABEL = r"^(Short answer|Overview|What is uncertain|Who can help|This week)\s*:\s*"
