"""Fixed values for chat topics and social contact scoring."""

# Topic domains and the title keywords that put a conversation into them.
DOMAIN_RULES = {
    "art_park": [
        "art park", "sculpture park", "sculpture garden", "sculpture trail", "mural festival",
        "art installation", "public art", "art vision", "art-driven", "art driven",
        "revitalization", "cultural campus", "gathering", "festival", "campground", "glamping",
        "campsite", "space activation", "skate park", "nonprofit setup", "501c3",
        "foundation overview", "master plan", "visitor center",
    ],
    "real_estate": [
        "real estate", "property", "land deal", "subdivision", "seller financ", "mortgage",
        "loan agreement", "construction loan", "1031 exchange", "house sale",
        "building a house", "home build", "well drilling", "water rights", "easement",
        "deal memo", "deal structure", "land purchase", "investment property", "adu",
        "drywall", "square footage", "concrete", "plywood", "permit requirements",
        "contractor", "construction", "home design", "house design", "kitchen design",
        "shelving", "tile coverage",
    ],
    "finance": [
        "investment", "market", "stock", "bitcoin", "btc", "crypto", "gold", "etf", "dividend",
        "portfolio", "recession", "inflation", "tariff", "net worth", "financial health",
        "financial position", "ira", "tax", "capital gains", "loan payment", "valuation",
        "run rate", "revenue", "budget breakdown", "market analysis", "market outlook",
        "macro trend", "interest rate", "bond yield", "options trading", "cap rate",
        "rebalance",
    ],
    "memoir_creative": [
        "memoir", "artist bio", "artist statement", "artistic journey", "hero's journey",
        "authenticity", "art philosophy", "manuscript", "book", "writing", "podcast",
        "documentary", "script", "brand brief", "brand", "merch", "logo", "design",
        "storefront sign", "social media", "content creation", "marketing", "ted talk",
        "manifesto", "year in review", "interview", "transcript",
    ],
    "life_personal": [
        "life vision", "future vision", "self discovery", "self-discovery",
        "personal philosophy", "core beliefs", "5 year plan", "goals", "life optimization",
        "life path", "dating", "relationship", "marriage", "parenting", "meditation",
        "retreat", "yoga", "fasting", "health", "fitness", "sleep", "nutrition", "travel",
        "itinerary", "packing", "jet lag", "visa", "residency", "homestead", "garden",
        "harvest", "recipe", "birthday", "holiday", "gratitude", "journaling",
    ],
    "reference_legal": [
        "agreement", "contract", "lease", "consignment", "dissolution", "termination",
        "eviction", "trademark", "gdpr", "bylaws", "ordinance", "zoning", "rfp", "loi",
        "proposal", "at-will employment", "severance", "resignation",
    ],
}

# Titles of throw-away conversations.
SKIP_PATTERNS = [
    r"^new chat$",
    r"days (between|until)",
    r"(sq|square) (meters?|feet|footage) to",
    r"^(acres?|gallons?) (in|to|conversion)",
    r"cubic feet",
    r"^(sum|total|percentage|calculate|calculation)",
    r"^date calculation",
    r"unit conversion",
    r"^turn (me|photo)",
    r"^image (creation|transformation|aesthetic)",
    r"^(change|update) (color|image|time)",
    r"^(animate|remix) (a |)photo",
    r"^full body render",
    r"^(explain|read|extract) (image|text|pdf|script)",
    r"synonym for",
    r"quick question",
]

# Text cuts of a chat summary.
USER_TEXT_CUT = 2000
REPLY_TEXT_CUT = 1500

# Keyword lists of the social contact score.
PROFESSIONAL_WORDS = [
    "startup", "invest", "investor", "funding", "raise", "round", "hire", "hiring", "engineer",
    "developer", "team", "partner", "partnership", "collaborate", "collab", "business",
    "revenue", "growth", "strategy", "advisor", "advise", "mentor", "board", "launch",
    "product", "company", "founder", "ceo", "cto", "coo", "deal", "client", "agency", "brand",
    "campaign", "facebook", "social media", "advertising", "marketing", "conference",
    "speaking", "panel", "event", "pitch", "deck", "demo", "intro", "introduction",
    "connect you", "coffee", "lunch", "dinner", "drinks", "beer", "office", "meet up",
    "meetup", "catch up",
]
WARMTH_WORDS = [
    "miss you", "love you", "proud of you", "congrats", "congratulations", "grateful",
    "appreciate", "thank you", "thanks for", "happy birthday", "wedding", "married", "family",
    "brother", "sister", "mom", "dad", "let's hang", "come visit", "when are you",
    "great seeing you", "good to see you",
]
FOLLOWUP_WORDS = [
    "let's catch up", "we should", "next time", "let me know", "keep in touch",
    "stay in touch", "looking forward", "i'll be in", "are you in", "are you around",
    "would love to", "i'd love to", "we need to", "come by", "stop by", "swing by", "soon",
    "when are you free",
]
# Keyword groups that add a contact tag.
TAG_WORDS = {
    "Investor/Funding": ["invest", "investor", "funding", "raise", "round"],
    "Recruiting": ["hire", "hiring", "engineer", "developer", "team"],
    "Advisor": ["advisor", "mentor", "advise"],
    "Collaborator": ["partner", "collaborate", "collab", "partnership"],
    "Industry": ["speaking", "panel", "conference", "event"],
    "Connector": ["intro", "introduction", "connect you"],
}
# Points by year of the last message; other years give 1.
RECENCY_POINTS = {2012: 10, 2011: 7, 2010: 4}
