"""Word lists, tokens, formats and limits that define the results.

Everything here is data. Changing an entry changes what the engine recognises, not how it runs.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: cell texts that mean "missing" when a delimited file is read -----------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: texts read as booleans --------------------------------------------------------
TRUE_WORDS = ("true", "yes", "t", "y", "1")
FALSE_WORDS = ("false", "no", "f", "n", "0")

# --- fixed values: shapes ------------------------------------------------------------------------
CURRENCY_SYMBOLS = "₹$€£¥"
DATE_HINT = r"\d{2,4}[-/\.]\d{1,2}|[A-Za-z]{3,9}\s+\d{1,2}|\d{1,2}\s+[A-Za-z]{3,9}"
PHONE_SHAPE = r"^[\+\(\)\-\s\d\.]{7,20}$"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
STRICT_DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
FIRST_YEAR, LAST_YEAR = 1678, 2261

# --- fixed values: column names that settle the semantic type, tried in this order ---------------
NAME_HINTS: tuple[tuple[str, frozenset[str]], ...] = (
    ("email", frozenset({"email", "email_address", "e_mail", "mail"})),
    ("phone", frozenset({
        "phone", "mobile", "cell", "telephone", "tel", "contact", "phone_number", "mobile_number",
        "contact_number"})),
    ("date", frozenset({
        "date", "dob", "birth", "created", "updated", "signup", "join", "joined", "timestamp",
        "order_date", "purchase_date", "date_of_birth", "created_at", "updated_at"})),
    ("name", frozenset({
        "name", "full_name", "fullname", "first_name", "last_name", "fname", "lname",
        "customer_name", "client_name"})),
    ("city", frozenset({"city", "town", "location", "place", "district", "municipality"})),
    ("address", frozenset({"address", "addr", "street", "locality", "area"})),
    ("id", frozenset({
        "id", "uid", "user_id", "customer_id", "order_id", "employee_id", "product_id",
        "transaction_id", "account_id", "ref", "reference"})),
    ("age", frozenset({"age", "years_old", "age_years"})),
)

# --- fixed values: semantic type -> (display label, badge) ---------------------------------------
LABELS = {
    "email": ("Email", "sem-email"),
    "phone": ("Phone", "sem-phone"),
    "date": ("Date", "sem-date"),
    "boolean": ("Boolean", "sem-bool"),
    "numeric_string": ("Numeric String", "sem-numstr"),
    "integer": ("Integer", "sem-num"),
    "float": ("Float", "sem-num"),
    "currency": ("Currency", "sem-numstr"),
    "name": ("Name", "sem-text"),
    "city": ("City", "sem-text"),
    "address": ("Address", "sem-text"),
    "id": ("ID", "sem-num"),
    "age": ("Age", "sem-num"),
    "text": ("Text", "sem-text"),
    "unknown": ("Unknown", "sem-text"),
}

# --- fixed values: canonical city names; on equal scores the earlier name wins -------------------
CITIES = (
    # India
    "Mumbai", "Delhi", "Bangalore", "Bengaluru", "Hyderabad", "Chennai",
    "Kolkata", "Pune", "Ahmedabad", "Jaipur", "Surat", "Lucknow", "Kanpur",
    "Nagpur", "Indore", "Thane", "Bhopal", "Visakhapatnam", "Pimpri-Chinchwad",
    "Patna", "Vadodara", "Ghaziabad", "Ludhiana", "Agra", "Nashik", "Faridabad",
    "Meerut", "Rajkot", "Kalyan-Dombivali", "Vasai-Virar", "Varanasi",
    "Srinagar", "Aurangabad", "Dhanbad", "Amritsar", "Navi Mumbai", "Allahabad",
    "Howrah", "Ranchi", "Coimbatore", "Jabalpur", "Gwalior", "Vijayawada",
    "Jodhpur", "Madurai", "Raipur", "Kota", "Guwahati", "Chandigarh",
    "Thiruvananthapuram", "Mysuru", "Mysore", "Noida", "Gurugram", "Gurgaon",
    # elsewhere
    "New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia",
    "San Antonio", "San Diego", "Dallas", "San Jose", "London", "Paris",
    "Berlin", "Tokyo", "Beijing", "Shanghai", "Sydney", "Melbourne",
    "Toronto", "Vancouver", "Dubai", "Singapore", "Hong Kong",
)

# --- fixed values: top-level names no public mailbox can live under ------------------------------
SPECIAL_USE_DOMAINS = ("arpa", "invalid", "local", "localhost", "onion", "test")

# --- fixed values: thresholds --------------------------------------------------------------------
CITY_DETECT_SCORE = 82
CITY_FIX_SCORE = 80
FUZZY_SCORE = 85
FUZZY_MIN_CHARS = 3
NUMERIC_GATE = 0.5
BOOLEAN_GATE = 0.8
AGE_RANGE = (0, 120)
IQR_FACTOR = 1.5
MIN_VALUES_FOR_TREATMENT = 4


@dataclass(frozen=True)
class PhoneRule:
    """One numbering plan: calling code, national trunk prefix, shape of the national number."""

    country: str
    calling_code: str
    trunk: str
    national: str


# --- fixed values: numbering plans; the longest calling code that fits wins ----------------------
PHONE_RULES = (
    PhoneRule("IN", "91", "0", r"[1-9]\d{9}"),
    PhoneRule("US", "1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    PhoneRule("GB", "44", "0", r"[1-9]\d{8,9}"),
    PhoneRule("AU", "61", "0", r"[1-478]\d{8}"),
    PhoneRule("DE", "49", "0", r"[1-9]\d{5,10}"),
    PhoneRule("FR", "33", "0", r"[1-9]\d{8}"),
    PhoneRule("SG", "65", "", r"[3689]\d{7}"),
    PhoneRule("AE", "971", "0", r"[2-9]\d{7,8}"),
    PhoneRule("JP", "81", "0", r"[1-9]\d{8,9}"),
    PhoneRule("CN", "86", "0", r"1[3-9]\d{9}"),
)
DEFAULT_COUNTRY = "IN"

# --- fixed values: assigned country calling codes: short ones, then third digits by zone ----------
SHORT_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98",
)
CODE_ZONES = {
    "21": "12368", "22": "0123456789", "23": "0123456789", "24": "0123456789", "25": "012345678", "26": "0123456789",
    "29": "01789", "35": "0123456789", "37": "0123456789", "38": "01235679", "42": "013", "50": "0123456789",
    "59": "0123456789", "67": "023456789", "68": "012356789", "69": "012", "80": "08", "85": "02356", "87": "08",
    "88": "012368", "96": "012345678", "97": "012345679", "99": "234568",
}
#: Digits of a whole international number, calling code included, and of its national part at least.
E164_DIGITS, NATIONAL_DIGITS = 15, 4
