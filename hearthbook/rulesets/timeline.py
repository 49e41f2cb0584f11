"""Fixed values for timeline events, eras and narrative roles."""

# Event type by first matching pattern, in this order.
EVENT_RULES = [
    ("financial", r"invoice|payment|paid|receipt|wire transfer|deposit|refund"),
    ("legal", r"signed|executed|agreement|contract|nda|mou|term sheet"),
    ("transaction", r"purchased|bought|sold|sale|acquisition|closed"),
    ("launch", r"launch|launched|live|published|released|shipped|delivered"),
    ("approval", r"approved|granted|permit|licensed|certified|accepted"),
    ("completion", r"completed|finished|done|wrapped|final|delivered"),
    ("hiring", r"hired|started|joined|onboarded|welcome aboard"),
    ("departure", r"terminated|fired|resigned|departed|last day|offboarded"),
    ("press", r"article|published|featured|interview|podcast|press|coverage"),
    ("recognition", r"award|won|recognized|nominated|selected|chosen"),
    ("installation", r"installed|built|constructed|erected|assembled|mounted"),
    ("logistics", r"moved|relocated|arrived|delivered|shipped"),
    ("opening", r"opened|grand opening|ribbon cutting|unveil"),
    ("scheduled", r"confirmed|booked|scheduled|rsvp|attending"),
    ("cancelled", r"cancelled|postponed|rescheduled|declined"),
]

# One-letter marks of the event types on rendered timelines.
EVENT_MARKS = {
    "financial": "$", "legal": "L", "transaction": "T", "launch": "R", "approval": "A",
    "completion": "C", "hiring": "H", "departure": "D", "press": "P", "recognition": "W",
    "installation": "I", "logistics": "M", "opening": "O", "scheduled": "S", "cancelled": "X",
}

# Era name, first year it may overlap from, last year a first contact may have.
CONTACT_ERAS = [
    ("pre_brand", None, 2014),
    ("brand_launch", 2014, 2016),
    ("brand_commission", 2016, 2019),
    ("community_platform", 2019, 2022),
    ("art_park", 2023, None),
]

# Press era by publication year, both ends inclusive.
PRESS_ERAS = [
    ("pre-artist", 2007, 2014),
    ("early-artist", 2015, 2016),
    ("pink-house-era", 2017, 2017),
    ("private-jet-era", 2018, 2019),
    ("monolith-era", 2020, 2021),
    ("transition-era", 2022, 2023),
    ("art-park-era", 2024, 2029),
]

# Narrative role by first group with a keyword in the summary text.
NARRATIVE_RULES = [
    ("backer", ["invest", "fund", "capital", "backer", "seed", "raise"]),
    ("mentor/connector", ["mentor", "advisor", "introduced", "connected", "referred"]),
    ("chronicler", ["press", "article", "interview", "coverage", "journalist", "reporter"]),
    ("antagonist", ["dispute", "threaten", "fraud", "conflict", "broke down", "extort"]),
    ("family", ["family", "mother", "father", "brother", "sister", "wife", "fiance"]),
    ("collector/patron", ["collector", "bought", "purchased", "commission"]),
    ("builder", ["build", "install", "fabricat", "construct", "architect"]),
    ("civic partner", ["civic", "city", "county", "government", "mayor", "commissioner"]),
]

# Theme pattern and the tags it adds.
THEME_RULES = [
    (r"art park|sculpture park|glamping", ["art-park"]),
    (r"monolith|monoliths|utah.*desert|mysterious.*metal|wales.*monolith",
     ["monolith", "stunt", "viral"]),
    (r"pink house|hot pink|mid.city.*pink|millennial pink.*house",
     ["pink-houses", "los-angeles", "stunt", "instagram"]),
    (r"fyre|fyre festival|fyre experience", ["fyre-festival", "stunt", "pop-up"]),
    (r"private jet|selfiecircus|jet.*selfie|gulfstream",
     ["private-jet-experience", "selfie", "los-angeles", "instagram"]),
    (r"\bnft\b|non.fungible|nifty gateway|okcoin|polygon.*nft|treetrunk|web3",
     ["nft", "crypto", "web3"]),
    (r"\bai\b|artificial intelligence|machine learning|algorithm.*art", ["ai", "technology"]),
    (r"kanye|yeezy|kanye.*loves", ["kanye", "celebrity", "pop-up"]),
    (r"miley|cyrus|hemsworth|instagram.*proposal", ["miley-cyrus", "celebrity", "instagram"]),
    (r"snapchat|snap.*inc|yellow.*accelerator|augmented reality",
     ["snapchat", "technology", "social-media"]),
    (r"instagram|instagrammable|selfie.*backdrop", ["instagram", "social-media"]),
    (r"event festival", ["burning-man"]),
    (r"cash.*art|selling.*money|stacks.*cash|cash.*brick|bundles.*cash",
     ["cash-art", "stunt", "instagram"]),
    (r"gucci", ["gucci", "fashion", "collaboration"]),
    (r"ariana grande|rainbow mural", ["ariana-grande", "mural", "collaboration"]),
    (r"french bulldog|dog.*paint", ["dog-art", "stunt", "viral"]),
    (r"identical twins", ["twins", "collaboration"]),
    (r"facebook class|startup accelerator", ["pre-artist-career", "tech"]),
    (r"dispensar|cannabis|weed", ["cannabis", "mural", "los-angeles"]),
    (r"art basel", ["art-basel", "art-world"]),
    (r"nude snapchat|publishing.*nude", ["snapchat", "controversy", "stunt"]),
]
