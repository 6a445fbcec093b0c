"""Fixed values. They decide results, so they are stated as plain text in one place."""

# --- Labels -----------------------------------------------------------------

CATEGORIES = ["Billing", "Technical", "Account", "Refund", "General"]
PRIORITIES = ["Critical", "High", "Medium", "Low"]
DEPARTMENTS = ["Finance", "Technical", "Account", "Refunds", "General Support"]
DIFFICULTIES = ["easy", "medium", "hard", "ambiguous"]

DEFAULT_DEPARTMENT = {
    "Billing": "Finance",
    "Technical": "Technical",
    "Account": "Account",
    "Refund": "Refunds",
    "General": "General Support",
}

CROSS_DEPARTMENTS = {
    "Billing": ["Refunds"],
    "Refund": ["Finance"],
    "Account": ["Technical"],
    "General": ["Finance", "Technical", "Account", "Refunds"],
}

FIELDS = ["ticket_id", "customer_name", "contact_number", "review",
          "timestamp", "category", "priority", "department"]

METADATA = ["generation_batch", "generation_source", "scenario_type", "difficulty",
            "teacher_model", "generation_timestamp", "dataset_version", "key_index"]

# --- Keyword lists (substring tests on lower-cased text) ----------------------

REFUND_WORDS = ["refund", "reverse", "reversal", "money back", "return money", "reimburse",
                "reimbursement", "credit back"]

BILLING_WORDS = ["bill", "charge", "charged", "deduct", "deducted", "invoice", "payment",
                 "recharge", "rupees", "rs.", "rs ", "amount", "balance", "overcharged",
                 "extra charge", "duplicate charge"]

TECHNICAL_WORDS = ["network", "signal", "tower", "speed", "slow", "outage", "call drop", "sms",
                   "internet", "fiber", "broadband", "dead", "4g", "5g", "wifi", "connectivity",
                   "connection", "latency", "ping", "data", "streaming", "buffering", "router",
                   "modem"]

ACCOUNT_WORDS = ["sim", "account", "login", "password", "blocked", "kyc", "ownership", "profile",
                 "unblock", "puk", "port", "number", "registered", "locked", "activate",
                 "deactivate", "linked"]

CRITICAL_WORDS = ["medical emergency", "ambulance", "hospital", "life support", "oxygen support",
                  "emergency contact", "life-threatening", "sim swap", "sim hijack",
                  "identity theft", "account hijack", "fraud", "hacked",
                  "unauthorized transaction", "money stolen", "entire area down",
                  "complete outage", "tower collapsed", "police", "legal notice",
                  "consumer court", "fir filed"]

HIGH_WORDS = ["suspended", "disconnected", "cut off", "terminated", "blocked service",
              "deducted twice", "charged twice", "double charge", "duplicate charge", "asap",
              "urgent", "urgently", "immediately", "not working", "dead", "down",
              "since yesterday", "since 2 days", "since 3 days", "for 2 days", "for 3 days",
              "past 2 days", "past 3 days", "2 days", "3 days", "4 days", "5 days", "failed",
              "failure", "no service", "cannot make calls", "can't call", "unable to call",
              "calls dropping", "call drops", "no internet", "no signal",
              "refund not received", "refund pending", "refund delayed", "affecting work",
              "losing business", "work is affected", "clients affected"]

MEDIUM_WORDS = ["slow", "issue", "problem", "intermittent", "sometimes", "occasionally",
                "not always", "bit slow", "minor", "inconvenient", "recharge not applied",
                "balance not updated", "showing wrong", "incorrect", "discrepancy", "dropping",
                "call drop", "drops", "frequently", "low speed", "bill shows", "wrong charge",
                "incorrect charge", "extra charge", "not received", "still pending",
                "not updated", "not reflecting"]

# First list with a hit decides; the second member is the label when none has one.
CATEGORY_RULES = [("Refund", REFUND_WORDS), ("Billing", BILLING_WORDS),
                  ("Technical", TECHNICAL_WORDS), ("Account", ACCOUNT_WORDS)]
CATEGORY_ELSE = "General"
PRIORITY_RULES = [("Critical", CRITICAL_WORDS), ("High", HIGH_WORDS), ("Medium", MEDIUM_WORDS)]
PRIORITY_ELSE = "Low"

# --- Confidence ---------------------------------------------------------------

PRIORITY_BASE = {"Critical": 0.83, "High": 0.77, "Medium": 0.72, "Low": 0.66}
PER_HIT, HIT_LIMIT = 0.022, 0.10
LENGTH_VERY_SHORT, LENGTH_SHORT, LENGTH_LONG = 15, 35, 700
LENGTH_IDEAL = (70, 350)
LENGTH_TERMS = {"very_short": -0.10, "short": -0.05, "long": -0.04, "ideal": 0.025}
PER_SIGNAL, SIGNAL_LIMIT = 0.013, 0.07
VOCABULARY_MIN_WORDS, VOCABULARY_CENTRE, VOCABULARY_WEIGHT = 5, 0.5, 0.04
JITTER_MODULUS, JITTER_WIDTH = 10000, 0.12
CONFIDENCE_FLOOR, CONFIDENCE_CEILING = 0.62, 0.95
MEAN_WEIGHT, MIN_WEIGHT = 0.75, 0.25

# Signals of a concrete complaint: amount, date, phone, reference id, time, troubleshooting.
SIGNAL_PATTERNS = [
    r"\b(rs\.?\s*\d+|\d[\d,.]*\s*rupees?|\$\d+)\b",
    r"\b\d{1,2}[\/\-]\d{1,2}([\/\-]\d{2,4})?\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b",
    r"\b\d{10}\b",
    r"\b(ticket|ref|order|txn|transaction|invoice|complaint)\s*#?\s*[\w\-]+\b",
    r"\b(since|from|yesterday|today|this\s*morning|last\s*(night|week)|for\s*\d+|past\s*\d+|\d+\s*(hours?|days?|weeks?))\b",
    r"\b(tried|attempt|reboot|restart|reset|checked|verified|called\s*support)\b",
]

# --- Safety rules -------------------------------------------------------------

# Ordered: the first rule that matches gives the reason.
CRITICAL_RULES = [
    (
        r"\b(medical\s*emergency|hospital|ambulance|emergency\s*(call|service|contact|number)|"
        r"sos|life\s*support|oxygen\s*support|emergency|life.threatening|"
        r"call\s*(\d+\s*)?ambulance|need\s*(a\s*)?doctor|critical\s*patient)\b",
        "Emergency Hazard: Medical or life-safety service dependency",
    ),
    (
        r"\b(sim\s*swap|sim\s*hijack|sim\s*clon(ing|ed)|unauthorized\s*sim|identity\s*theft|"
        r"account\s*hijack|someone\s*(else\s*)?(is\s*)?(using|accessing)\s*my\s*(number|account|sim)|"
        r"otp\s*(going|coming|received)\s*(to|on|by)\s*(someone|another|different|old|unknown|"
        r"other)\s*(person|number|device))\b",
        "Security Hazard: Unauthorized SIM/identity takeover attempt",
    ),
    (
        r"\b(fraud(ulent)?(\s*(transaction|charge|deduction|activity))?|"
        r"unauthorized\s*(deduction|charge|payment|transfer|transaction)|"
        r"money\s*(stolen|missing|disappeared|gone\s*missing)|hacked|"
        r"account\s*(compromised|breached|taken\s*over)|"
        r"(never|did\s*not|didn['t]+)\s*(make|initiate|authorize|request)\s*(this|that|any|a)\s*"
        r"(transaction|payment|transfer|charge|purchase|request))\b",
        "Financial/Security Hazard: Suspected unauthorized transaction or account breach",
    ),
    (
        r"\b(complete\s*(network\s*)?(outage|failure|blackout|shutdown)|"
        r"entire\s*(area|city|town|colony|sector|building|floor|complex|zone)\s*(is\s*)?(down|dead|out|without\s*(network|internet|signal))|"
        r"tower\s*(collapsed|down|failed|not\s*working|dead)|"
        r"broadband\s*(completely|totally|fully|absolutely)\s*(dead|down|gone|failed|not\s*(working|responding))|"
        r"(whole|entire|complete)\s*(building|apartment|society|area|sector)\s*(has\s*)?"
        r"(no|lost|without)\s*(internet|signal|connectivity|service))\b",
        "Critical Infrastructure: Complete area or major infrastructure outage",
    ),
    (
        r"\b(police|fir\s*(filed|lodge)|file\s*(a\s*)?(police\s*)?complaint|"
        r"legal\s*(notice|action|case|proceedings)|consumer\s*(court|forum|protection)|"
        r"trai\s*complaint|nclt|court\s*(case|order)|lawyer|attorney|"
        r"going\s*to\s*(court|sue|file\s*a\s*case))\b",
        "Legal/Compliance Hazard: Formal legal or regulatory escalation",
    ),
]

HIGH_RULES = [
    r"\b(service\s*(has\s*been\s*)?(suspended|cut\s*off|disconnected|blocked|terminated|stopped)|"
    r"(connection|account|number|line)\s*(has\s*been\s*)?(suspended|cut|blocked|disconnected|terminated)|"
    r"(postpaid|prepaid|broadband|internet|mobile)\s*(service\s*)?(has\s*been\s*)?(suspended|disconnected|blocked|cut\s*off)|"
    r"suspended\s*(without|despite|even\s*though|since))\b",
    r"\b(deducted?\s*twice|charged\s*twice|double\s*(charge|deduction|billing|payment)|"
    r"duplicate\s*(charge|payment|deduction|transaction)|"
    r"amount\s*(deducted|charged)\s*(twice|two\s*times|double|again)|"
    r"(same|extra)\s*amount\s*(deducted|charged)\s*(twice|again|twice))\b",
    r"\b(since\s*(\d+\s*)?(days?|hours?)|for\s*(the\s*)?(\w+\s*)?(past\s+)?(\d+\s*)?(days?|hours?)|"
    r"past\s*(\d+\s*)?(days?|hours?)|last\s*(\d+\s*)?(days?|hours?)|"
    r"(2|3|4|5|6|7|two|three|four|five|six|seven)\s*days?\s*(back|ago|since|now)|"
    r"(not\s*working|down|dead|failed)\s*since\s*(yesterday|last\s*(night|evening|morning|week)))\b",
    r"\b(no\s*(incoming|outgoing)\s*(calls?|sms|messages?)|"
    r"calls?\s*(dropping|dropped|failing|failed|not\s*connecting|not\s*going\s*through)|"
    r"unable\s*to\s*(make|receive|place|answer)\s*(any\s*)?calls?|"
    r"(can['t]+|cannot)\s*(call|receive\s*calls?|make\s*calls?))\b",
    r"\b(refund\s*(not|never)\s*(received|credited|processed|done|arrived)|"
    r"refund\s*(pending|delayed|overdue|stuck|held|not\s*credited)|"
    r"waiting\s*(for\s*)?(a\s*)?refund|refund\s*(after|since)\s*\d+\s*(days?|weeks?)|"
    r"(still|yet)\s*(no|haven['t]+\s*(received|got))\s*refund)\b",
    r"\b(suspicious\s*(activity|login|access|transaction)|"
    r"unknown\s*(device|login|access|transaction|charge)|"
    r"password\s*(changed|reset)\s*without\s*(my|authorization|permission)|"
    r"(someone\s*)?(else\s*)?logged\s*(in|into)\s*my\s*account)\b",
    r"\b(affecting\s*(my\s*)?(work|business|office|clients?|customers?)|"
    r"losing\s*(business|clients?|customers?|money)|"
    r"(work|business|office)\s*(is\s*)?(affected|impacted|disrupted|stopped)|"
    r"can['t]+\s*(work|do\s*my\s*job|run\s*(my\s*)?business))\b",
]

# category -> (wrong departments, corrected department)
DEPARTMENT_FIXES = [
    ("Refund", ["Technical", "General Support"], "Refunds"),
    ("Billing", ["General Support"], "Finance"),
    ("Technical", ["Finance"], "Technical"),
    ("Account", ["Finance", "General Support"], "Account"),
]

CONFIDENCE_THRESHOLD = 0.70
CRITICAL_CONFIDENCE = 0.90
MODEL_VERSION = "qwen2.5-3b-qlora-v1.0"

# --- Masking ------------------------------------------------------------------

CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
CARD_MASK = "[CARD-MASKED]"
CODE_PATTERN = r"\b(OTP|otp|pin|PIN)\s*[:=]?\s*\d{4,6}\b"
CODE_MASK = "[MASKED]"

# --- Ingest -------------------------------------------------------------------

REVIEW_HEADERS = ["review", "complaint", "text", "ticket_text"]
NAME_HEADERS = ["name", "customer_name", "customer"]
CONTACT_HEADERS = ["contact_number", "contact", "phone", "mobile"]
TIME_HEADERS = ["timestamp", "date", "time"]
# Cell texts that count as missing in an uploaded CSV.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
UNKNOWN_CONTACT = "+91-XXXXXXXXXX"
UNKNOWN_CUSTOMER = "Anonymous Customer"

PASS_ALL_NOTE = "Bulk approved via Pass All"
OVERRIDE_NOTE = "Manager manual override from filter table"

# --- Data preparation -----------------------------------------------------------

SHINGLE_WORDS = 3
SIMILARITY_PERCENT = 85
PLACEHOLDERS = ["n/a", "none", "test", ""]
REVIEW_MIN_LENGTH = 5
IMBALANCE_LIMIT = 10
SWEEP_THRESHOLDS = [0.70, 0.75, 0.80, 0.82, 0.85, 0.88, 0.90]
FUTURE_SHARE, VALIDATION_SHARE, TEST_SHARE = "0.10", "0.15", "0.15"

SYSTEM_PROMPT = (
    "You are a support-ticket triage classifier for a telecom company. "
    "Given a customer support ticket, respond with ONLY a strict JSON object "
    "with exactly these keys: \"category\", \"priority\", \"department\". "
    "No explanation, no extra text, no markdown fences.\n\n"
    "category must be one of: Billing, Technical, Account, Refund, General\n"
    "priority must be one of: Critical, High, Medium, Low\n"
    "department must be one of: Finance, Technical, Account, Refunds, General Support"
)

# --- Scenario plan (weights in percent) -------------------------------------------

SCENARIOS = {
    "Billing": [
        "incorrect charges on bill", "unexpected bill amount", "duplicate billing",
        "payment deducted but not reflected", "recharge payment issue",
        "incorrect plan charge", "billing mismatch between plan and invoice",
    ],
    "Technical": [
        "network unavailable in area", "poor signal strength", "mobile data not working",
        "slow internet speed", "calls dropping repeatedly", "SMS not sending or receiving",
        "SIM card or network registration issue", "repeated service failures",
    ],
    "Account": [
        "unable to log into account", "account locked after failed attempts",
        "cannot access account portal", "profile information incorrect",
        "SIM ownership or transfer issue", "need to update registered info",
    ],
    "Refund": [
        "refund requested but still pending", "refund not received after cancellation",
        "failed transaction needs refund", "recharge refund request",
        "payment reversal not processed",
    ],
    "General": [
        "asking about plan details", "asking about recharge options",
        "general service question", "non-urgent query about offers",
    ],
}

CATEGORY_WEIGHTS = {"Billing": 25, "Technical": 30, "Account": 18, "Refund": 15, "General": 12}

PRIORITY_WEIGHTS = {
    "Billing":   {"Critical": 5, "High": 25, "Medium": 45, "Low": 25},
    "Technical": {"Critical": 15, "High": 35, "Medium": 35, "Low": 15},
    "Account":   {"Critical": 10, "High": 30, "Medium": 40, "Low": 20},
    "Refund":    {"Critical": 5, "High": 30, "Medium": 45, "Low": 20},
    "General":   {"Critical": 0, "High": 5, "Medium": 30, "Low": 65},
}

DIFFICULTY_WEIGHTS = {"easy": 35, "medium": 35, "hard": 20, "ambiguous": 10}
CROSS_DEPARTMENT_PERCENT = 8

TOPUP_TARGETS = [
    ("General", "Low", "Account", 9),
    ("Refund", "Critical", "Finance", 9),
    ("Billing", "Critical", "Refunds", 9),
    ("General", "Medium", "Finance", 9),
    ("General", "Medium", "Refunds", 8),
    ("General", "Low", "Finance", 8),
    ("Account", "Low", "Technical", 6),
    ("Refund", "High", "Finance", 6),
    ("Refund", "Low", "Finance", 7),
]

FIRST_NAMES = ["Aarav", "Priya", "Rohan", "Sneha", "Vikram", "Ananya", "Karan", "Divya",
               "Rahul", "Neha", "Arjun", "Pooja", "Sanjay", "Kavya", "Aditya", "Isha",
               "Manoj", "Ritu", "Suresh", "Meera"]
LAST_NAMES = ["Sharma", "Patel", "Verma", "Gupta", "Nair", "Reddy", "Iyer", "Chauhan",
              "Mehta", "Joshi", "Kapoor", "Desai", "Rao", "Bhat", "Malhotra"]
PHONE_PREFIXES = ["98", "99", "97", "96", "70", "80", "90"]
TIMESTAMP_DAYS, TIMESTAMP_HOURS = 180, 23

GENERATION_SYSTEM_PROMPT = (
    "You are generating a SINGLE synthetic customer support ticket for a telecom "
    "company, for training-data purposes only. Output STRICT JSON only, matching "
    "exactly this schema and nothing else: "
    "{\"review\": string, \"category\": string, \"priority\": string, \"department\": string}. "
    "The review field must sound like a real Indian telecom customer wrote it, "
    "natural, sometimes informal or with mild spelling issues, varied tone and length. "
    "Do NOT include the customer name or phone number inside the review text. "
    "Do not repeat sentence templates across tickets. Keep review under 80 words. "
    "Valid categories: Billing, Technical, Account, Refund, General. "
    "Valid priorities: Critical, High, Medium, Low. "
    "Valid departments: Finance, Technical, Account, Refunds, General Support."
)

DIFFICULTY_INSTRUCTIONS = {
    "easy": "Write a clear, straightforward complaint with an obvious category and priority.",
    "medium": "Write a realistic complaint with some ambiguity in tone but a clear underlying issue.",
    "hard": "Write a complaint that mixes in a secondary minor issue or missing context, making classification non-trivial.",
    "ambiguous": "Write a complaint that is somewhat vague or could plausibly fit more than one category, but still leans toward the target category on balance.",
}

GENERATION_USER_PROMPT = (
    "Scenario: {scenario} (category: {category}).\n"
    "Target priority: {priority} - the complaint tone/urgency/impact should "
    "realistically justify this priority level.\n"
    "Target department: {department}.\n"
    "Difficulty: {difficulty}. {instruction}\n"
    "Return the JSON object now."
)

# What a top-up prompt adds after the department.
TOPUP_DEPARTMENT_NOTE = (
    " (this ticket legitimately belongs to this "
    "department even though it may differ from the most obvious default department "
    "for this category - that is intentional)"
)

# White space that str.strip and str.split recognise in Python.
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
