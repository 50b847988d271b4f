"""Vocabularies of the engine: categories, priorities, lists and patterns.

Patterns are Java expressions. (?U) makes word, digit and space classes and word boundaries Unicode-aware, (?i) ignores case, (?d) lets a
dot stop at line feeds only.
"""

from __future__ import annotations

from dataclasses import dataclass

# Categories, lists, tables and patterns below are given by the data model and must not change.

HIGH_CONFIDENCE = (
    "ssn", "itin", "ein", "email", "phone", "credit_card", "bank_account", "routing_number", "passport", "drivers_license", "ip_address", "iban", "swift",
    "us_ssn", "date_of_birth", "tax_id", "vin", "mrn",
)

REVIEW_CATEGORIES = (
    "name", "location", "organization", "date", "postal_code", "url", "username", "id_number", "address", "account_number", "customer_id", "employee_id", "invoice", "order_number",
    "reference_number", "case_number", "policy_number", "license_number", "money", "alphanumeric_id", "percentage", "other",
)

TYPE_PRIORITY = (
    "ssn", "itin", "ein", "tax_id", "credit_card", "bank_account", "routing_number", "iban", "swift", "mrn", "date_of_birth", "invoice", "order_number", "customer_id", "employee_id",
    "account_number", "reference_number", "case_number", "policy_number", "license_number", "phone", "email", "ip_address", "passport", "drivers_license", "vin", "license_plate",
    "address", "location", "postal_code", "url", "username", "id_number", "alphanumeric_id", "organization", "name", "date", "money",
)

TYPE_ALIASES = {"name_caps": "name", "location_indian": "location", "username_lax": "username"}

FALSE_POSITIVES = (
    "ssn", "dob", "ein", "tin", "mrn", "vin", "pin", "cvv", "cvc", "atm", "pos", "aba", "ach", "eft", "iban", "bic", "swift",
    "credit card", "bank account", "routing number", "account number", "phone number", "email address", "date of birth", "social security",
    "license plate", "order number", "invoice number", "customer id", "employee id", "patient id", "policy number", "reference number",
)

BLOCKLIST = (
    "confidential", "employee", "record", "information", "details", "financial", "contact", "references", "medical", "vehicle",
    "summary", "report", "document", "section", "appendix", "name", "address", "phone", "email", "date", "number",
    "customer", "account", "invoice", "order", "reference", "policy", "license", "insurance", "routing", "credit",
    "employee record", "contact information", "financial details", "routing number", "credit card", "bank account", "social security",
    "license plate", "order number", "customer id", "employee id",
)

NAME_PHRASES = (
    "contact information", "financial details", "routing number", "credit card", "bank account", "social security", "license plate",
    "date of birth", "employee id", "customer id", "order number", "invoice number", "reference number", "account number",
    "patient id", "medical record", "insurance policy", "main street", "new york", "los angeles", "san francisco",
)

SKIP_VALUES = (
    "id", "number", "no", "num", "#", "na", "n/a", "none", "null", "record", "information", "details", "data", "field",
    "name", "address", "phone", "email", "date", "account", "customer", "employee", "patient", "policy", "invoice",
    "order", "reference", "case", "file", "ticket", "license", "plate", "card", "ssn", "tax", "bank", "routing", "credit",
)

SWIFT_WORDS = ("EMPLOYEE", "CUSTOMER", "DOCUMENT", "REFERENCE")
ID_WORDS = ("ABCDEFGHIJ", "QWERTYUIOP")

PSEUDONYM_PREFIXES = {
    "name": "PERSON", "email": "EMAIL", "phone": "PHONE", "ssn": "SSN", "itin": "TAX_ID", "ein": "TAX_ID", "tax_id": "TAX_ID", "credit_card": "CARD",
    "bank_account": "ACCOUNT", "routing_number": "ROUTING", "iban": "IBAN", "swift": "SWIFT", "organization": "ORG", "location": "LOCATION",
    "address": "ADDRESS", "postal_code": "ZIP", "date": "DATE", "date_of_birth": "DOB", "ip_address": "IP", "url": "URL", "username": "USER",
    "passport": "PASSPORT", "drivers_license": "LICENSE", "vin": "VIN", "license_plate": "PLATE", "mrn": "MRN", "customer_id": "CUST",
    "employee_id": "EMP", "invoice": "INV", "order_number": "ORDER", "account_number": "ACCT", "reference_number": "REF", "case_number": "CASE",
    "policy_number": "POLICY", "id_number": "ID", "money": "AMOUNT",
}

PRESIDIO_TYPES = {
    "person": "name", "email_address": "email", "phone_number": "phone", "us_ssn": "ssn", "credit_card": "credit_card", "location": "location",
    "date_time": "date", "ip_address": "ip_address", "url": "url", "iban_code": "iban", "us_bank_number": "bank_account",
    "us_driver_license": "drivers_license", "us_passport": "passport", "us_itin": "itin", "uk_nhs": "mrn", "medical_license": "license_number",
    "nrp": "name", "organization": "organization",
}

SPACY_TYPES = {
    "person": "name", "gpe": "location", "loc": "location", "org": "organization", "date": "date", "time": "date", "money": "money",
    "percent": "percentage", "norp": "name", "fac": "address",
}

HTML_ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#x27;", "'"), ("&#x2F;", "/"),
    ("&ndash;", "-"), ("&mdash;", "-"), ("&hellip;", "..."), ("&copy;", "(c)"), ("&reg;", "(R)"), ("&trade;", "(TM)"),
)

REGION_HINTS = (
    (r"\b(?:name|customer|client|patient|employee)[:\s]", "name"),
    (r"\b(?:phone|tel|mobile|cell|contact)[:\s]", "phone"),
    (r"\b(?:email|e-mail)[:\s]", "email"),
    (r"\b(?:ssn|social security)[:\s]", "ssn"),
    (r"\b(?:account|acct)[:\s]", "account"),
    (r"\b(?:address|street|city)[:\s]", "address"),
    (r"\b(?:dob|date of birth|birthday)[:\s]", "date"),
    (r"\b(?:card|credit|debit)[:\s]", "credit_card"),
)


@dataclass(frozen=True)
class Pattern:
    """A named expression; guard is a cheap necessary condition, in SQL over the columns of spans.prepared().

    Matches of a `dense` pattern have a digit in each of their words, so a text can only match if its words with digits, joined by
    spaces, do.
    """

    name: str
    kind: str
    regex: str
    flags: str = "U"
    guard: str = "true"
    dense: bool = False

    @property
    def java(self) -> str:
        return f"(?{self.flags})(?:{self.regex})" if self.flags else self.regex


DIGIT = "__n <> ''"


def some(*words: str) -> str:
    """SQL: the folded text holds one of these words somewhere."""
    return " OR ".join(f"contains(__l, '{w}')" for w in words)


# The detector's patterns, in order of priority.
PATTERNS = (
    Pattern("ssn", "ssn", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", dense=True),
    Pattern("itin", "itin", r"\b9\d{2}-[7-9]\d-\d{4}\b", dense=True),
    Pattern("ein", "ein", r"\b\d{2}-\d{7}\b", dense=True),
    Pattern("credit_card", "credit_card", r"\b(?:4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}|5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}|3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}|6(?:011|5\d{2})[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4})\b", dense=True),
    Pattern("iban", "iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", dense=True),
    Pattern("swift", "swift", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", guard="__u RLIKE '[A-Z]{6}'"),
    Pattern("routing_number", "routing_number", r"\b(?:0[1-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)\d{7}\b", dense=True),
    Pattern("email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+(?:[A-Za-z]{2,})?\b", guard="contains(__t, '@')"),
    Pattern("phone", "phone", r"\b(?:(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}|\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}|(?:\+?44[-.\s]?)?(?:0|\(0\))?\d{2,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}|(?:\+?91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5})\b", dense=True),
    Pattern("ipv4", "ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", dense=True),
    Pattern("ipv6", "ip_address", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", guard="contains(__t, ':')"),
    Pattern("mac_address", "mac_address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", guard="contains(__t, ':') OR contains(__t, '-')"),
    Pattern("url", "url", r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[/\w\-._~:/?#\[\]@!$&'()*+,;=%]*", guard="contains(__t, '://')"),
    Pattern("address", "address", r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct|Place|Pl|Circle|Cir)\.?\b", "Ui", DIGIT),
    Pattern("zip_code", "postal_code", r"\b\d{5}(?:-\d{4})?\b", dense=True),
    Pattern("uk_postcode", "postal_code", r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", "Ui", dense=True),
    Pattern("pin_code", "postal_code", r"\b[1-9]\d{5}\b", dense=True),
    Pattern("passport_us", "passport", r"\b[A-Z]\d{8}\b|\b\d{9}\b", dense=True),
    Pattern("drivers_license", "drivers_license", r"\b(?:[A-Z]\d{7}|[A-Z]\d{12}|[A-Z]{2}\d{6}|\d{7,9}|[A-Z]\d{3}-\d{4}-\d{4})\b", dense=True),
    Pattern("vin", "vin", r"\b[A-HJ-NPR-Z0-9]{17}\b", guard="__n <> '' OR __u RLIKE '[A-Z]{17}'"),
    Pattern("license_plate", "license_plate", r"\b(?:[A-Z]{1,3}[- \t]?\d{1,4}[- \t]?[A-Z0-9]{0,3}|\d{1,3}[- \t]?[A-Z]{1,4}[- \t]?[A-Z0-9]{0,3})\b", guard=DIGIT + r" AND __t RLIKE '[A-Z][- \\t]?\\p{Nd}|\\p{Nd}[- \\t]?[A-Z]'"),
    Pattern("date_of_birth", "date_of_birth", r"\b(?:DOB|Date of Birth|Born|Birthday|Birth Date)[:\s]+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", "Ui", DIGIT),
    Pattern("invoice", "invoice", r"\b(?:INV|Invoice|Bill)[-:#\s]*[A-Z0-9-]{4,20}\b", "Ui", guard=some("inv", "bill")),
    Pattern("order_number", "order_number", r"\b(?:Order|ORD|PO)[-:#\s]*[A-Z0-9-]{4,20}\b", "Ui", guard=some("ord", "po")),
    Pattern("customer_id", "customer_id", r"\b(?:Customer|Client|CID|CUST)[-:#\s]*[A-Z0-9-]{4,20}\b", "Ui", guard=some("customer", "client", "cid", "cust")),
    Pattern("employee_id", "employee_id", r"\b(?:EMP|Employee\s*ID)[-:#\s]*[A-Z0-9-]{4,15}\b", "Ui", guard=some("emp")),
    Pattern("mrn", "mrn", r"\b(?:MRN|Medical Record|Patient ID)[-:#\s]*[A-Z0-9-]{4,15}\b", "Ui", guard=some("mrn", "medical record", "patient id")),
    Pattern("case_number", "case_number", r"\b(?:Case|Ref|Reference|File)[-:#\s]*[A-Z0-9-]{4,20}\b", "Ui", guard=some("case", "ref", "file")),
    Pattern("account_number", "account_number", r"\b(?:Account|Acct|A/C)[-:#\s]*[A-Z0-9-]{4,20}\b", "Ui", guard=some("account", "acct", "a/c")),
    Pattern("location_indian", "location_indian", r"\b(?:Kerala|Karnataka|Maharashtra|Tamil Nadu|Delhi|Gujarat|Rajasthan|Punjab|Haryana|Bengaluru|Mumbai|Chennai|Kolkata|Hyderabad|Pune|Alappuzha|Kochi|Trivandrum)\b", "Ui", some("kerala", "karnataka", "maharashtra", "tamil nadu", "delhi", "gujarat", "rajasthan", "punjab", "haryana", "bengaluru", "mumbai", "chennai", "kolkata", "hyderabad", "pune", "alappuzha", "kochi", "trivandrum")),
    Pattern("name_caps", "name_caps", r"\b[A-Z]{2,}(?:\s+[A-Z]{1,})+\b", guard="__u <> ''"),
    Pattern("username", "username", r"(?:^|(?<=[^a-zA-Z0-9]))@[A-Za-z][A-Za-z0-9_]{2,30}\b", guard="contains(__t, '@')"),
    Pattern("username_lax", "username_lax", r"\b[a-z]+(?:[-_][a-z0-9]+)+[a-z0-9]*\b", guard="contains(__t, '-') OR contains(__t, '_')"),
    Pattern("alphanumeric_id", "id_number", r"\b(?=.*[A-Z])(?=.*\d)[A-Z0-9]{10,20}\b", "Ud", "__n <> '' AND (__n RLIKE '[A-Z0-9]{10}' OR __u RLIKE '[A-Z0-9]{10}')"),
    Pattern("name", "name", r"\b(?:[A-Z][a-z]+[ \t]+){1,3}[A-Z][a-z]+\b", guard="__t RLIKE '[a-z][ \\t]+[A-Z][a-z]'"),
    Pattern("date", "date", r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b", "Ui", DIGIT + r" AND (__n RLIKE '\\p{Nd}[-/]\\p{Nd}' OR " + some("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec") + ")"),
    Pattern("percentage", "percentage", r"\b\d+(?:\.\d+)?\s*(?:%|percent)\b", "Ui", DIGIT + " AND (contains(__t, '%') OR contains(__l, 'percent'))"),
)

# Patterns that the detector has but doesn't run, and the words one of which must occur in the 50 characters before.
UNUSED_PATTERNS = (
    Pattern("ssn_nodash", "ssn", r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b", dense=True),
    Pattern("passport_uk", "passport", r"\b\d{9}\b", dense=True),
    Pattern("bank_account", "bank_account", r"\b\d{8,17}\b", dense=True),
)
LOOK_BEHIND = {"ssn_nodash": ("ssn", "social security", "social sec", "ss#", "ss #"), "bank_account": ("account", "acct", "a/c", "bank", "routing", "transfer")}

# Fixed values: (category, keyword, value, whether the value ignores case, largest gap), in order.
CONTEXT_RULES = (
    ("account_number", r"\b(?:account|acct|a/c)\s*(?:number|no\.?|num\.?|#)?[:\s]*", r"[A-Z0-9-]{4,20}", True, 5),
    ("customer_id", r"\b(?:customer|client|member)\s*(?:id|number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{4,20}", True, 5),
    ("employee_id", r"\b(?:employee|staff|worker|emp)\s*(?:id|number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{4,15}", True, 5),
    ("mrn", r"\b(?:patient|medical record|mrn|health record)\s*(?:id|number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{4,15}", True, 5),
    ("invoice", r"\b(?:invoice|bill|receipt)\s*(?:number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{4,20}", True, 5),
    ("order_number", r"\b(?:order|purchase order|po)\s*(?:number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{4,20}", True, 5),
    ("reference_number", r"\b(?:reference|ref|case|file|ticket)\s*(?:number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{4,20}", True, 5),
    ("policy_number", r"\b(?:policy|insurance)\s*(?:number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{6,20}", True, 5),
    ("license_number", r"\b(?:license|licence|permit)\s*(?:number|no\.?|#)?[:\s]*", r"[A-Z0-9-]{4,15}", True, 5),
    ("passport", r"\b(?:passport)\s*(?:number|no\.?|#)?[:\s]*", r"[A-Z0-9]{6,12}", True, 5),
    ("ssn", r"\b(?:social security|ssn|ss#|ss #)\s*(?:number|no\.?)?[:\s]*", r"\d{3}[-\s]?\d{2}[-\s]?\d{4}", False, 5),
    ("tax_id", r"\b(?:tax id|tin|taxpayer|ein|itin)\s*(?:number|no\.?|#)?[:\s]*", r"[\d-]{9,12}", False, 5),
    ("date_of_birth", r"\b(?:date of birth|dob|birth date|birthday|born)\s*[:\s]*", r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", False, 5),
    ("phone", r"\b(?:phone|tel|telephone|mobile|cell|contact)\s*(?:number|no\.?|#)?[:\s]*", r"[\d\s\-\(\)\.+]{7,20}", False, 5),
    ("email", r"\b(?:email|e-mail)\s*(?:address)?[:\s]*", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", False, 5),
    ("routing_number", r"\b(?:routing|aba|transit)\s*(?:number|no\.?|#)?[:\s]*", r"\d{9}", False, 5),
    ("credit_card", r"\b(?:credit card|card|cc)\s*(?:number|no\.?|#)?[:\s]*", r"[\d\s-]{13,19}", False, 5),
    ("bank_account", r"\b(?:bank account|checking|savings)\s*(?:number|no\.?|#)?[:\s]*", r"\d{8,17}", False, 5),
    ("vin", r"\b(?:vin|vehicle identification)\s*(?:number|no\.?|#)?[:\s]*", r"[A-HJ-NPR-Z0-9]{17}", False, 5),
    ("ip_address", r"\b(?:ip address|ip)\s*[:\s]*", r"(?:\d{1,3}\.){3}\d{1,3}", False, 5),
    ("address", r"\b(?:address|location|residence|mailing)\s*[:\s]*", r"[^\n.;]{10,100}", False, 0),
)

# The rule detector.
RULE_PATTERNS = (
    Pattern("rule_url", "url", r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[/\w\-._~:/?#\[\]@!$&'()*+,;=%]*", guard="contains(__t, '://')"),
    Pattern("rule_username", "username", r"(?:^|(?<=[^a-zA-Z0-9\-_\.]))@([A-Za-z]+[A-Za-z0-9\-_]+)", guard="contains(__t, '@')"),
    Pattern("rule_id", "id_number", r"\b[A-Z0-9]{10,20}\b", dense=True),
)

# The second pass and the legacy detector, which share them.
SECOND_PASS = (
    Pattern("phone_regex", "phone", r"\b(?:(?:\+?1[-.\s]*)?(?:\(\d{3}\)|\d{3})[-.\s]*\d{3}[-.\s]*\d{4}|(?:\+?91[-.\s]*)?[6-9]\d{4}[-.\s]*\d{5}|(?:\+?91[-.\s]*)?[6-9]\d{2}[-.\s]*\d{3}[-.\s]*\d{4}|0\d{2,4}[-.\s]+\d{3,4}[-.\s]+\d{3,4})\b", dense=True),
    Pattern("ssn_regex", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", dense=True),
    Pattern("email_regex", "email", r"\b[\w.-]+@[\w.-]+\.\w{2,}\b", guard="contains(__t, '@')"),
    Pattern("postal_regex", "postal_code", r"\b(?:\d{5}(?:-\d{4})?|\d{6}|\d{3}\s?\d{3})\b", dense=True),
    Pattern("name_heuristic", "name", r"\b(?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+\b", guard="__t RLIKE '(?U)[a-z]\\\\s+[A-Z][a-z]'"),
)
LEGACY_ORDER = ("ssn_regex", "email_regex", "phone_regex", "postal_regex", "name_heuristic")

# Urgency of review, manual categories, states.
CRITICAL_FLAGS = ("ssn", "phone", "credit_card", "ip_address")
CRITICAL_SPANS, ELEVATED_SPANS = ("ssn", "credit_card"), ("phone", "email", "ip_address")
DECISIONS = {"detector": ("approve", "reject"), "risk_flag": ("redact", "dismiss")}
MODES, STYLES = ("redact", "pseudonymize"), ("bars", "brackets")

# Repairs of normalisation, in order: what a text must hold for one to do anything, the expression, and what comes instead. A run
# of blanks that is one space already is left alone.
REPAIRS = (
    (None, r"[\t\r\f\x0B]+", " "),
    (r"@(?U:\s)*\n", r"(?U)(\S+@)\s*\n\s*(\S+)", "$1$2"),
    (r"(?U)\d[-.]?\s*\n", r"(?U)(\d+)[-.]?\s*\n\s*[-.]?(\d+)", "$1-$2"),
    (r"(?U)\d\s*-?\s*\n", r"(?U)(\d{3})\s*[-]?\s*\n\s*[-]?\s*(\d{2})\s*[-]?\s*\n?\s*[-]?\s*(\d{4})", "$1-$2-$3"),
    (None, r"(?U)[^\S\n]{2,}|[^\S\n ]", " "),
    (None, r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ""),
)
DASHES = ("\u2013\u2014", "--")

# Tokens rejoined over a line feed, and misreadings.
REJOINED = (
    (r"(?U)([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]*)\s*\n\s*([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1$2"),
    (r"(?U)(\d{3}[-.\s]?\d{3})[-.\s]?\n[-.\s]?(\d{4})", "$1-$2"),
    (r"(?U)(\d{4}[-.\s]?\d{4})[-.\s]?\n[-.\s]?(\d{4}[-.\s]?\d{4})", "$1-$2"),
    (r"(?U)(\d{3})[-.\s]?\n[-.\s]?(\d{2})[-.\s]?\n?[-.\s]?(\d{4})", "$1-$2-$3"),
)
MISREAD_DIGITS, NUMERIC_KINDS = ("OolISB", "001158"), ("phone", "ssn", "credit_card", "account")
MISREAD_ADDRESSES = ((" ", ""), ("rnail", "mail"), ("corn", "com"))

# The category that a bare text suggests, in order.
INFERRED = (
    (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z", "SSN"),
    (r"^[0-9]{3}-[0-9]{3}-[0-9]{4}\z", "PHONE"),
    ("@", "EMAIL"),
    (r"^\$[0-9,]+(\.[0-9]{2})?\z", "AMOUNT"),
    (r"(?i)^(January|February|March|April|May|June|July|August|September|October|November|December)(?U:\s+)[0-9]{1,2},(?U:\s+)[0-9]{4}\z", "DATE"),
    (r"^[A-Z][a-z]+((?U:\s+)[A-Z][a-z]+)*\z", "NAME"),
    (r"^[A-Z][a-z]+((?U:\s+)(&|and)(?U:\s+)[A-Z][a-z]+)+", "ORG"),
    (r"^([A-Z][a-z]*(?U:\s+))+[A-Z][a-z]*\z", "ORG"),
)
