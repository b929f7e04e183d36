"""Labels, phrase lists, quotas, thresholds and reason texts.

Results agree with earlier runs of these analyses only if these values are used as they stand.
Every operator takes its own list instead; nothing outside this file depends on the wording.
"""

# --- class labels -------------------------------------------------------------------------

INTENTS = [
    "delivery_problem", "order_management", "returns_refunds", "product_issue",
    "payment_billing", "amazon_pay", "account_access", "prime_membership",
    "digital_content", "product_information", "technical_issue", "support_followup", "other",
]

# --- weak labels: a message gets a class when exactly one class has a phrase in it ----------

LABEL_PHRASES = {
    "delivery_problem": [
        "not delivered", "not received", "where is my package", "where is my order",
        "delivery delayed", "delivery delay", "late delivery", "package late", "order late",
        "delivery date", "delivery hasn't", "delivery hasnt", "package hasn't",
        "package hasnt", "still waiting for my package",
    ],
    "order_management": [
        "cancel my order", "cancel order", "change my order", "modify my order",
        "change delivery address", "wrong address", "change shipping address", "order status",
    ],
    "returns_refunds": [
        "return this", "return my", "return an item", "want a refund", "need a refund",
        "refund my", "refund hasn't", "refund hasnt", "refund not", "replacement",
    ],
    "payment_billing": [
        "payment declined", "payment failed", "card declined", "credit card", "debit card",
        "charged twice", "charged me", "billing", "billing issue", "payment issue",
    ],
    "amazon_pay": [
        "amazon pay", "amazonpay", "pay balance", "amazon pay balance", "amazon pay cashback",
        "amazon pay cash", "recharge amazon pay", "top up amazon pay",
    ],
    "account_access": [
        "can't login", "cant login", "cannot login", "can't sign in", "cant sign in",
        "cannot sign in", "password", "account locked", "locked out", "verification code",
        "otp", "suspicious login", "someone accessed my account",
    ],
    "prime_membership": [
        "prime membership", "prime member", "prime subscription", "cancel prime",
        "prime charge", "prime fee", "prime benefits",
    ],
    "digital_content": [
        "prime video", "primevideo", "kindle", "ebook", "e-book", "audible",
        "digital content", "movie on prime", "movie coming to prime", "when is the movie",
        "streaming",
    ],
    "technical_issue": [
        "app is not working", "app isn't working", "app isnt working", "website not working",
        "website isn't working", "website isnt working", "error message",
        "technical problem", "technical issue", "not working", "doesn't work",
        "doesnt work", "cannot connect", "can't connect", "cant connect", "alexa app",
    ],
    "product_information": [
        "how much", "what is the price", "price of", "is this available", "availability",
        "specifications", "specs", "warranty", "when will this be available",
        "does this product",
    ],
    "product_issue": [
        "broken", "damaged", "defective", "doesn't work", "doesnt work", "not working",
        "wrong item", "faulty", "stopped working",
    ],
    "support_followup": [
        "still waiting for support", "no response", "nobody replied", "contacted support",
        "customer service", "customer care", "call me", "callback", "follow up", "follow-up",
    ],
}

OTHER_PHRASES = [
    "thank you amazon", "thanks amazon", "thank you amazonhelp", "thanks amazonhelp",
    "great service", "excellent service", "love amazon", "love amazon prime",
    "good job amazon", "well done amazon", "i love amazon", "please add",
    "please bring back", "feature request", "can you add", "you should add",
    "suggestion for amazon", "feedback for amazon",
]

OTHER_CLASS = "other"
OTHER_CLASS_CAP = 2_000
CLASS_CAP = 5_000

# --- candidate classes: most keywords present wins, ties in list order ----------------------

CANDIDATE_KEYWORDS = {
    "delivery_problem": [
        "delivery", "delivered", "package", "shipping", "courier", "arrive", "arrived",
        "late", "tracking", "shipment", "driver",
    ],
    "order_management": [
        "order", "cancel", "cancellation", "ordered", "purchase", "modify", "change order",
    ],
    "returns_refunds": [
        "refund", "return", "returned", "returning", "money back", "refunds", "pickup",
    ],
    "product_issue": [
        "broken", "damaged", "defective", "wrong item", "wrong product", "faulty",
        "doesn't work", "not working", "missing",
    ],
    "payment_billing": [
        "payment", "charged", "charge", "credit card", "debit card", "billing", "bill",
        "card", "transaction",
    ],
    "amazon_pay": ["amazon pay", "cashback", "cash back", "wallet", "balance", "recharge"],
    "account_access": [
        "account", "login", "log in", "password", "email", "locked", "security", "hack",
        "hacked",
    ],
    "prime_membership": [
        "prime", "membership", "member", "subscription", "prime video membership",
    ],
    "digital_content": [
        "kindle", "prime video", "video", "movie", "ebook", "book", "audible", "streaming",
    ],
    "product_information": [
        "warranty", "availability", "available", "price", "exchange", "specification",
        "size", "edition",
    ],
    "technical_issue": [
        "app", "website", "error", "bug", "crash", "loading", "checkout", "login error",
        "not working",
    ],
    "support_followup": [
        "customer service", "customer care", "support", "agent", "representative",
        "callback", "contact", "response", "reply",
    ],
}

CANDIDATES_PER_CLASS = 40

CLASS_QUOTAS = {
    "delivery_problem": 30, "order_management": 20, "returns_refunds": 20,
    "product_issue": 15, "payment_billing": 15, "amazon_pay": 10, "account_access": 15,
    "prime_membership": 15, "digital_content": 15, "product_information": 10,
    "technical_issue": 15, "support_followup": 10, "other": 10,
}

SAMPLE_SIZE = 500
SEED = "42"
FOLDS = 5

# --- relevance of retrieved messages: phrase of several words counts 2, one word 1 -----------

RELEVANCE_KEYWORDS = {
    "delivery_problem": [
        "delivery", "delivered", "package", "parcel", "shipping", "shipment", "arrived",
        "arrive", "delivery date", "tracking",
    ],
    "order_management": [
        "cancel order", "cancel my order", "order status", "modify order", "change order",
        "order",
    ],
    "returns_refunds": ["refund", "return", "returned", "money back", "refund money"],
    "product_issue": [
        "broken", "damaged", "defective", "faulty", "not working", "doesn't work",
        "does not work",
    ],
    "payment_billing": [
        "payment", "paid", "charged", "credit card", "debit card", "billing", "declined",
    ],
    "amazon_pay": ["amazon pay", "pay balance", "amazonpay"],
    "account_access": ["account", "password", "login", "log in", "sign in", "locked out"],
    "prime_membership": [
        "prime membership", "prime member", "amazon prime", "prime subscription", "prime",
    ],
    "digital_content": [
        "kindle", "ebook", "movie", "video", "music", "prime video", "audible", "stream",
    ],
    "product_information": [
        "price", "available", "availability", "specification", "specs", "when will",
        "do you have",
    ],
    "technical_issue": [
        "app", "website", "error", "crash", "not loading", "technical", "alexa", "device",
    ],
    "support_followup": [
        "still waiting", "follow up", "follow-up", "any update", "update", "contacted",
        "response", "reply",
    ],
}

UNKNOWN_CLASS = "unknown"

# --- term discovery -------------------------------------------------------------------------

STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "is", "am", "are", "was", "were",
    "be", "been", "being", "to", "of", "in", "on", "for", "with", "at", "by", "from", "this",
    "that", "it", "its", "i", "me", "my", "we", "you", "your", "our", "they", "them", "their",
    "he", "she", "do", "does", "did", "have", "has", "had", "can", "could", "would", "should",
    "will", "please", "just", "get", "got", "getting", "amazon", "amazonhelp",
]

TOP_TERMS = 100

# --- class override for explicit account compromise -------------------------------------------

OVERRIDE_CLASS = "account_access"
OVERRIDE_SIGNALS = ["hacked", "compromised", "unauthorized access", "unauthorized login"]
OVERRIDE_SUBJECTS = ["account"]
OVERRIDE_PHRASES = [
    "account hacked", "my account was hacked", "my account got hacked",
    "someone hacked my account", "someone has hacked my account",
    "someone accessed my account", "someone has accessed my account", "unauthorized access",
    "unauthorized login", "unauthorized transaction", "account compromised",
    "account was compromised", "account has been compromised", "identity theft",
    "someone is using my account", "someone used my account",
]

# --- routing ----------------------------------------------------------------------------------

CONFIDENCE_THRESHOLD = 0.60
SIMILARITY_THRESHOLD = 0.55
SHORT_PHRASE = 4

HIGH_RISK_PHRASES = [
    "fraud", "scam", "hacked", "someone accessed my account", "unauthorized", "stolen",
    "identity theft", "security breach", "chargeback", "legal action", "lawsuit", "police",
    "fir",
]
PRIOR_SUPPORT_PHRASES = [
    "already talked to customer service", "already contacted customer service",
    "already contacted support", "already talked to support", "talked to customer service",
    "talked to support", "spoke to customer service", "spoke to support",
    "contacted customer service", "contacted support", "called customer service",
    "called support", "sent mail to cs", "emailed customer service", "emailed support",
    "already reported", "already complained", "filed a complaint", "still not working",
    "still doesn't work", "still does not work", "still haven't received",
    "still have not received", "no results", "no response", "no one can tell me",
    "nothing happened", "not resolved", "we are stuck", "we're stuck", "multiple times",
    "multiple complaints", "still waiting",
]
REPEAT_WORDS = ["times", "complaints?", "attempts?", "calls?", "emails?"]
REPEATED_ATTEMPT_PHRASES = [
    "2 attempts", "2 attempt", "two attempts", "3 attempts", "3 attempt", "three attempts",
    "multiple attempts", "multiple tries", "failed attempts", "failed attempt",
]
CASHBACK_PHRASES = [
    "amazon pay cashback", "cashback since", "cashback for", "cashback not received",
    "cashback hasn't arrived", "cashback has not arrived",
]
FINANCIAL_TERMS = [
    "refund", "refunded", "refund money", "cashback", "money back", "payment", "charged",
]
UNRESOLVED_TERMS = [
    "still", "yet", "haven't", "have not", "not received", "not refunded", "no response",
    "no one", "waiting", "can't get", "cannot get", "missing",
]
PERSISTENCE_TERMS = [
    "for days", "for weeks", "for months", "again", "no results", "no response",
    "not resolved", "still waiting", "still unresolved", "nothing happened",
    "no one can tell me",
]
OPERATIONAL_TERMS = [
    "refund", "cashback", "delivery", "delivered", "package", "order", "preorder",
    "prime video", "fire stick", "alexa", "payment", "invoice", "email", "broken",
    "not working",
]
PRIVATE_SUPPORT_PHRASES = [
    "can't dm", "cannot dm", "can't direct message", "cannot direct message", "dm me",
    "message me privately", "sensitive issue", "can someone call me", "please call me",
    "call me",
]
POSITIVE_PHRASES = [
    "thank you", "thanks", "appreciate it", "great service", "excellent service",
    "good job", "shout out", "well done",
]

ROUTING_REASONS = {
    "high_risk": "High-risk issue detected: '%s'. Human review required.",
    "prior_support": "Customer indicates a previous support interaction remains unresolved. "
    "Human follow-up is appropriate.",
    "repeat_signal": "Customer reports repeated support attempts or complaints. "
    "Human follow-up is appropriate.",
    "repeated_attempt": "Customer reports repeated failed attempts. "
    "Human follow-up is appropriate.",
    "cashback": "Unresolved financial issue detected. Human review is appropriate.",
    "financial": "Customer reports an unresolved financial issue. "
    "Human review is appropriate.",
    "persistent": "Customer describes a persistent unresolved support issue. "
    "Human follow-up is appropriate.",
    "private": "Customer requests private or sensitive support. "
    "Human follow-up is appropriate.",
    "other_positive": "Message is positive feedback without an unresolved support issue.",
    "other_unmapped": "Message could not be confidently mapped to a supported workflow and "
    "lacks strong historical evidence.",
    "other_plain": "Message does not contain a clear high-risk or unresolved-support signal.",
    "low_both": "Low classifier confidence (%.2f) and weak historical evidence "
    "(similarity %.2f).",
    "weak_evidence": "Historical evidence is weak (similarity %.2f below threshold %.2f).",
    "auto": "Intent confidence and historical evidence are strong enough for automated "
    "handling.",
}

# --- annotation and review ----------------------------------------------------------------------

REVIEW_CONFIDENCE = 70
MAX_RETRIES = 3
BULK_NOTE = "Bulk accepted from AI suggestion; not individually human-reviewed."
REVIEW_REASONS = [
    "ai_gold_intent_disagreement",
    "ai_gold_escalation_disagreement",
    "low_ai_confidence",
    "candidate_disagreement",
    "bulk_accepted_not_human_reviewed",
]
SCORE_DIMENSIONS = [
    "grounding", "resolution_correctness", "relevance", "safety", "style", "overall",
]

# --- evaluation ---------------------------------------------------------------------------------

CONFIDENCE_BINS = [0.0, 0.50, 0.70, 0.85, 1.01]
CONFIDENCE_BIN_NAMES = ["<0.50", "0.50-0.70", "0.70-0.85", ">=0.85"]
FALLBACK_THRESHOLDS = [0.20, 0.30, 0.40, 0.50, 0.60]
FAILURE_CONFIDENCE = 0.60
