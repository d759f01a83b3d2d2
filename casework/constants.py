"""Fixed values.

Everything in this module is a value that must be equal to the one used by the
case-record pipeline we reproduce (search codes, decision terms, word lists,
regular expressions, labels, mappings), stated once, in natural order. Code
elsewhere refers to these names and never repeats the literals.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original pipeline for identical results)
# ---------------------------------------------------------------------------

# Search requests: subject code, class code, page size, sort field.
SUBJECT_SEARCH_CODE = 12487
CLASS_SEARCH_CODE = 12729
MAX_HITS_PER_REQUEST = 10000

# Instance whose decisions are selected.
FIRST_INSTANCE = "G1"

# Movement names containing any of these (case-sensitive) are decisions.
DECISION_TERMS = [
    "Procedência",
    "Improcedência",
    "Improcedência do pedido e improcedência do pedido contraposto",
    "Procedência do pedido e procedência do pedido contraposto",
]

# Outcome types kept after the first decision per case, in this order.
OUTCOME_TYPES = [
    "Procedência",
    "Improcedência",
    "Improcedência do pedido e improcedência do pedido contraposto",
    "Procedência do pedido e procedência do pedido contraposto",
]

# A decision name containing this word is a favourable outcome.
FAVOURABLE_MARKER = "Procedência"

# Expected share of cases with public decision text.
PUBLIC_TEXT_SHARE = 0.683

# Name validation: words that may not appear in a judge name (case-sensitive).
INVALID_JUDGE_WORDS = ["Especial", "Cível", "Criminal", "Direito", "Vara"]
# ... a name may not start with "de " (any case) nor end with these.
INVALID_JUDGE_PREFIX_REGEX = r"^de\s+"
INVALID_JUDGE_SUFFIXES = [" de", " da", " do"]

# Judge name patterns, tried in order over the raw page (ignore case).
JUDGE_PATTERNS = [
    r"Juiz(?:a)?\s+de\s+Direito\s*[:\-]\s*([A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][a-zàáâãçéêíóôõú]+(?:\s+[A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][a-zàáâãçéêíóôõú]+)+)",
    r"Juiz(?:a)?\s*[:\-]\s*([A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][a-zàáâãçéêíóôõú]+(?:\s+[A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][a-zàáâãçéêíóôõú]+)+)",
    r"Juiz(?:a)?[^>]{0,80}?([A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][a-zàáâãçéêíóôõú]{2,}(?:\s+(?:de|da|do|dos|das)\s+[A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][a-zàáâãçéêíóôõú]+|\s+[A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][a-zàáâãçéêíóôõú]{2,})+)",
]

# Page elements and markers.
JUDGE_ELEMENT_ID = "juizPrimeiraDivTable"
PARTIES_TABLE_ID = "tablePartesPrincipais"
CLAIMANT_LABELS = ["Requerente", "Autor", "Massa Falida"]
NOT_FOUND_MARKER = "Não existem informações"
DECISION_TEXT_TERMS = [
    "Julgado procedente o pedido",
    "Julgado improcedente o pedido",
    "Procedência",
    "Improcedência",
]
DECISION_TEXT_MIN_CHARS = 50

# Extraction statuses.
STATUS_OK = "sucesso"
STATUS_NOT_FOUND = "nao_encontrado"
STATUS_INCOMPLETE = "dados_incompletos"
STATUS_ERROR = "erro"
STATUSES = [STATUS_OK, STATUS_NOT_FOUND, STATUS_INCOMPLETE, STATUS_ERROR]
DROPPED_STATUSES = [STATUS_NOT_FOUND, STATUS_ERROR]

# Name dictionary lookup results.
UNKNOWN_SEX = "Indefinido"
SEX_CODES = {"M": 0, "F": 1, "Indefinido": -1}
SEX_CODE_DEFAULT = -1
TRUE_TEXT = "True"

# Feature extraction.
DEFAULT_SUBJECT = "Desconhecido"
APPEAL_WORDS = ["agravo", "apelação", "recurso"]
CAPITAL_MARKER = "FORTALEZA"
URGENCY_WORDS = ["tutela", "urgencia"]  # unaccented "urgencia", as in the original
OBLIGATION_PHRASE = "obrigação de fazer"
MORAL_DAMAGE_PHRASE = "dano moral"
LUNCH_FIRST_HOUR = 11
LUNCH_LAST_HOUR = 13
MONDAY = 0
FRIDAY = 4
VELOCITY_DECIMALS = 4
COMPACT_TS_FORMAT = "yyyyMMddHHmmss"
ONE_HOT_PREFIX = "eh_"
ONE_HOT_NAME_MAX = 60

# Analysis notebook.
LOCAL_TIME_ZONE = "America/Sao_Paulo"
MEMBER_SUBJECT = "Acordo de Não Persecução Penal"
OFFICE_FIRST_HOUR = 8   # positional slice [8:19] of the hour histogram
OFFICE_END_HOUR = 19
OFFICE_LABELS = ["Das 9h às 19h", "Fora do expediente"]
MONTH_LABEL_PREFIX = "Mês de "
TOP_UNITS = 100
TOP_DECISION_TYPES = 10
SAMPLE_ROWS = 5
REPORT_SEPARATOR = "\n-----------------------------------------------------------------------------\n\n"

# Block sample (tutorial): take 20, skip 60.
BLOCK_SIZE = 20
BLOCK_SKIP = 60
