"""Word lists, patterns and thresholds that decide results."""

# --- fixed values: spellings of countries -------------------------------------------------
COUNTRY_SYNONYMS = {
    "usa": "United States",
    "u.s.a.": "United States",
    "us": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
}
COUNTRY_NAME_WORDS = ["country", "nation", "region"]
SYNONYM_SHARE = 0.3

# --- fixed values: date detection ---------------------------------------------------------
DATE_NAME_WORDS = ["date", "time", "year", "month", "day", "timestamp", "period"]
DATE_SHARE = 0.8
DATE_SHARE_WITH_NAME = 0.5
# the shape of a text and the datetime pattern that reads it; the first that fits counts
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?$", None),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{4}$", "yyyy"),
    (r"^[A-Z][a-z]{2} \d{4}$", "MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}$", "d MMMM yyyy"),
]

# --- fixed values: cleaning ---------------------------------------------------------------
MISSING_SHARE_LEFT_ALONE = 0.4
ORDER_CORRELATION = 0.5
OUTLIER_Z = 3.0
WINSOR_LOW, WINSOR_HIGH = 0.01, 0.99

# --- fixed values: column roles -----------------------------------------------------------
IDENTIFIER_PATTERN = (
    r"(^|[_\s\-])(id|key|code|zip|postal|row|index|num|number|identifier)($|[_\s\-])"
)
IDENTIFIER_NAMES = ["userid", "customerid", "orderid", "patientid"]
CALENDAR_PART_PATTERN = (
    r"(^|[_\s\-])(year|yr|month|day|quarter|qtr|week|hour|minute)($|[_\s\-])"
)
FINANCIAL_WORDS = [
    "salary", "estimatedsalary", "estimated_salary", "revenue", "sales", "profit", "amount",
    "price", "cost", "spend", "income", "budget", "margin", "clv", "orders", "transactions",
    "balance",
]
TARGET_WORDS = [
    "purchased", "conversion", "converted", "churn", "subscribed", "target", "clicks", "bought",
]
RATING_WORDS = ["rating", "score", "nps", "csat", "satisfaction", "gpa", "accuracy"]
DEMOGRAPHIC_WORDS = [
    "age", "height", "weight", "temp", "temperature", "heartrate", "heart_rate",
    "blood_pressure", "tenure",
]
KPI_WORDS = [
    "revenue", "sales", "profit", "amount", "price", "cost", "orders", "users", "margin", "clv",
    "quantity",
]
GEO_WORDS = ["city", "state", "country", "region", "zip", "lat", "lon", "location"]
KNOWN_COUNTRIES = [
    "united states", "usa", "canada", "mexico", "uk", "germany", "france", "india", "china",
    "japan", "australia", "brazil",
]
# metrics that are averaged, not summed, when no aggregation is named
AVERAGED_WORDS = [
    "age", "rating", "score", "temp", "temperature", "heartrate", "rate", "pct", "percentage",
    "percent", "ratio", "margin", "latency", "tenure", "gpa",
]

# --- fixed values: personal data ----------------------------------------------------------
PII_NAME_PATTERNS = [
    (r"(email|e_mail|mail)", "email", 0.9),
    (r"(phone|tel|mobile|cell)", "phone", 0.9),
    (r"(ssn|social_security|socialsecurity)", "ssn", 0.95),
    (r"(credit_card|creditcard|cc_num|card_number|cc\b|card\b)", "credit_card", 0.9),
    (r"(passport|passport_num)", "passport", 0.85),
    (r"(driver_license|driverlicense|dl_num)", "driver_license", 0.85),
    (r"(address|street|zip|postal)", "address", 0.7),
    (r"(name|first_name|last_name|full_name|fname|lname)", "name", 0.6),
    (r"(dob|date_of_birth|birth)", "dob", 0.8),
    (r"(ip_address|ip\b)", "ip_address", 0.7),
]
PII_VALUE_PATTERNS = [
    (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "email", 0.95),
    (r"^(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$", "phone", 0.9),
    (r"^\d{3}-\d{2}-\d{4}$", "ssn", 0.95),
    (r"^(\d{4}[- ]?){3}\d{4}$|^\d{13,16}$", "credit_card", 0.85),
    (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "ip_address", 0.8),
]
PII_TYPE_ORDER = [
    "email", "phone", "ssn", "credit_card", "ip_address", "passport", "driver_license",
    "address", "name", "dob",
]
PII_MASK_CONFIDENCE = 0.7

# --- fixed values: questions --------------------------------------------------------------
TIME_RANGE_PATTERNS = [
    (r"\blast\s+(\d+)\s+(month|year|quarter|week|day)s?\b", "last_n"),
    (r"\bpast\s+(\d+)\s+(month|year|quarter|week|day)s?\b", "last_n"),
    (r"\blast\s+quarter\b", "last_quarter"),
    (r"\bthis\s+quarter\b", "this_quarter"),
    (r"\blast\s+year\b", "last_year"),
    (r"\b(?:this|current|latest)\s+year\b", "this_year"),
    (r"\b(?:year\s+to\s+date|ytd)\b", "ytd"),
    (r"\b(?:month\s+over\s+month|mom)\b", "mom"),
    (r"\b(?:year\s+over\s+year|yoy)\b", "yoy"),
    (r"\b(?:in|for|of)\s+(20\d{2})\b", "year"),
]
COMPARE_PATTERN = r"\b(?:compare|vs\.?|versus|against|difference\s+between)\b"
COMPARE_PAIR_PATTERN = r"(\w+)\s+(?:vs\.?|versus|against)\s+(\w+)"
RANKED_PATTERN = r"\b(top|bottom|best|worst|highest|lowest)\s*(\d+)?\b"
TOP_WORDS = ["top", "best", "highest"]
OVERVIEW_WORDS = [
    "everything", "overview", "analyze", "analyse", "dashboard", "all charts", "full analysis",
    "show me", "insights",
]
FOLLOW_UP_STARTS = [
    "now ", "and ", "also ", "but ", "what about", "how about", "show only", "filter by",
]
FOLLOW_UP_WORDS = ["that", "those", "instead", "same", "break down", "by"]
FOLLOW_UP_MAX_WORDS = 6
EDIT_PHRASES = [
    "add a column", "add column", "drop column", "remove column", "rename column",
    "fill missing", "fill in missing", "change type", "convert column", "filter rows",
    "filter out",
]
HISTORY_LENGTH = 20
