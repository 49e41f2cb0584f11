"""OCR text categories. Patterns keep their order; it breaks score ties."""

# Coarse categories, every hit counts one.
COARSE_RULES = {
    "Messages": [
        r"imessage", r"delivered", r"read \d{1,2}:\d{2}", r"message\b",
        r"(send|type) (a )?message", r"whatsapp", r"telegram", r"signal", r"tapback",
        r"iMessage", r"\b(today|yesterday) \d{1,2}:\d{2}\s*(am|pm)",
    ],
    "Social_Media": [
        r"instagram", r"@\w+", r"follow(ers|ing)", r"(like|comment|share|retweet|repost)",
        r"twitter|tweet", r"\bx\.com\b", r"tiktok", r"reddit", r"r/", r"facebook", r"fb\.com",
        r"snapchat", r"snap", r"linkedin", r"youtube", r"(stories|reels|posts)",
        r"(upvote|downvote)",
    ],
    "Receipts": [
        r"(order|receipt|invoice|transaction)", r"(total|subtotal|tax|paid|amount)",
        r"\$\d+\.\d{2}", r"(credit|debit) card", r"(confirmation|tracking)\s*(number|#)",
        r"(shipped|delivered|estimated delivery)",
        r"(visa|mastercard|amex|paypal|venmo|zelle|apple pay)", r"(purchase|payment)",
    ],
    "Maps": [
        r"(directions|navigate|route)", r"(miles?|km|min(utes?)?) (away|left)",
        r"(apple|google) maps", r"(arrive|arrival|eta|depart)",
        r"(highway|interstate|freeway|exit)",
    ],
    "Web_Articles": [
        r"(safari|chrome|firefox|brave)", r"(aA|aa)\s*\|\s*", r"https?://", r"www\.",
        r"(read more|continue reading|subscribe)", r"(article|blog|news)",
    ],
    "Settings": [
        r"\bsettings?\b.*\b(general|display|privacy|notifications)", r"(toggle|switch|slider)",
        r"(wi-?fi|bluetooth|cellular|airplane)", r"(do not disturb|focus|screen time)",
    ],
    "Notes": [r"\bnotes?\b", r"(checklist|to-?do)", r"(bullet|numbered list)"],
}

# Refined categories with the weight of each hit.
REFINED_RULES = {
    "Instagram_Messages": (3, [
        r"instagram.*message", r"send\s*message.*instagram", r"(seen|active)\s+\d+[mh]\s+ago",
        r"vanish\s*mode", r"@\w+.*replied to your (story|message)",
    ]),
    "Instagram_Profiles": (3, [
        r"\d+\s*(posts?|followers?|following)", r"(edit profile|share profile)",
        r"(bio|website)\s*:", r"www\.instagram\.com", r"(followed by|follows you)",
        r"message\s+follow",
    ]),
    "Instagram_Stories": (3, [
        r"add to your story", r"story.*reply", r"seen by \d+", r"your story",
    ]),
    "Instagram_Posts": (2, [
        r"instagram", r"@\w{3,}", r"(liked by|likes?)\s+\w",
        r"(view all|view more)\s+\d+\s+comment", r"(reels?|explore)", r"sponsored",
    ]),
    "WhatsApp_Chats": (3, [
        r"whatsapp", r"(today|yesterday),?\s+\d{1,2}:\d{2}\s*(am|pm)",
        r"(end-to-end encrypted)", r"(voice|video) call", r"(online|last seen)",
    ]),
    "iMessage_Chats": (3, [
        r"imessage", r"delivered", r"read\s+\d{1,2}:\d{2}", r"(tapback|message effect)",
        r"(text message|sms)",
    ]),
    "Twitter_X": (3, [
        r"(twitter|tweet|retweet)", r"x\.com", r"(repost|quote\s*tweet)",
        r"(views?|impressions)\s+\d+", r"(bookmark|spaces)",
    ]),
    "TikTok": (3, [r"tiktok", r"(for you|fyp)", r"(duet|stitch)"]),
    "Reddit": (3, [
        r"reddit", r"r/\w+", r"(upvote|downvote|karma)", r"(subreddit|crosspost)",
    ]),
    "Inspirational": (2, [
        r"(believe|dream|inspire|motivat|courage|strength)",
        r"(never give up|keep going|you can)", r"(success|greatness|purpose|passion)",
        r"(quote|wisdom|mindset)", r"(life is|happiness is)",
    ]),
    "Receipts_Finance": (3, [
        r"\$\d+\.\d{2}", r"(order|receipt|invoice|transaction)", r"(total|subtotal|tax)",
        r"(visa|mastercard|amex|paypal|venmo|zelle|apple\s*pay)",
        r"(shipped|tracking|delivery)", r"(bank|account|balance|transfer)",
        r"(credit|debit)\s*card",
    ]),
    "Maps_Navigation": (3, [
        r"(directions|navigate|route)", r"(miles?|km|min)\s+(away|left)",
        r"(apple|google)\s*maps", r"(arrive|arrival|eta)", r"(highway|interstate|exit \d)",
    ]),
    "Music_Podcasts": (3, [
        r"(spotify|apple music|soundcloud)", r"(now playing|playing from)",
        r"(podcast|episode \d)", r"(shuffle|repeat|queue)", r"(playlist|album|artist)",
    ]),
    "Dating_Apps": (3, [
        r"(tinder|hinge|bumble|match\.com)", r"(swipe|super like|rose)",
        r"(it'?s a match|matched with)", r"(dating|looking for)",
    ]),
    "Food_Delivery": (3, [
        r"(ubereats|doordash|grubhub|postmates|instacart)",
        r"(order (placed|confirmed|delivered))", r"(delivery fee|service fee|tip)",
        r"(estimated delivery|your order)",
    ]),
    "Web_Articles": (1, [
        r"https?://", r"www\.", r"(safari|chrome|firefox)", r"(read more|continue reading)",
        r"(subscribe|newsletter)",
    ]),
    "App_Settings": (2, [
        r"settings", r"(wi-?fi|bluetooth|cellular|airplane)",
        r"(notifications|privacy|general)", r"(do not disturb|focus|screen time)",
    ]),
    "Notes_Lists": (2, [
        r"\bnotes?\b", r"(checklist|to-?do|reminder)", r"(grocery|shopping)\s*list",
    ]),
}

# Detailed categories, one (weight, pattern) per signal.
DETAILED_RULES = {
    "Google Search": [
        (10, r"AlMode.{0,5}All Images"), (10, r"Al Overview"),
        (8, r"Q\..{3,50}\s+G\s*@"), (8, r"All Images (Shopping|Videos|News)"),
        (6, r"Google\s+Q\."), (5, r"Search instead for"),
        (5, r"Images may be subject to copyright"),
    ],
    "Google Maps / Navigation": [
        (10, r"(Directions|DIRECTIONS)\s"),
        (8, r"\d+\s*(mi|miles?|km)\s+\d+\s*(min|hr|hours?)"),
        (8, r"(ETA|arrival|Arrive)\s*:?\s*\d"), (8, r"(Navigate|Route\s+overview)"),
        (6, r"(Google Maps|Apple Maps|maps\.google|maps\.apple)"),
        (5, r"(State Route|Interstate|Highway|Freeway)\s+\d"), (5, r"(exit|Exit)\s+\d"),
        (5, r"Economy Seat|Plane Changes|Flight"),
    ],
    "Stocks / Crypto / Finance": [
        (10, r"\$[A-Z]{2,5}\b"), (8, r"(Mkt Cap|Market Cap|Liquidity)"),
        (8, r"(stock|shares?|portfolio|dividend|earnings)"),
        (8, r"(bitcoin|ethereum|crypto|token|presale|defi|solana|SOL)"),
        (6, r"(bull|bear)\s*(market|run|ish)"), (5, r"(trading|trader|invest(ing|ment|or))"),
        (5, r"(hedge fund|capital|equity|yield|bond)"),
        (5, r"(buy|sell)\s+(stock|share|position)"), (4, r"(Dow|S&P|NASDAQ|NYSE)"),
    ],
    "Receipts / Purchases": [
        (10, r"(CHECKOUT|checkout|Order\s+(placed|confirmed))"),
        (8, r"\$\d+\.\d{2}.{0,20}(afterpay|Klarna|payment)"),
        (8, r"(receipt|invoice|order\s+total)"), (6, r"(Add to Cart|Shop now|Buy now)"),
        (5, r"\$\d+\.\d{2}"), (4, r"(shipping|delivery fee|tax|subtotal)"),
        (4, r"(Salomon|Nike|shoe|sneaker|kickscrew)"),
    ],
    "Instagram Post": [
        (6, r"(Liked by|likes)\s+\w"), (5, r"View all \d+ comment"),
        (4, r"Suggested for you"), (3, r"@\w{3,}"), (3, r"Follow\s+(eee|see|vee|\.\.\.)"),
        (2, r"A\s+Q\s+[GCS©]\)"), (2, r"(hours?|minutes?|days?)\s+ago"),
    ],
    "Instagram Profile": [
        (10, r"\d+\s*posts?\s+\d+\s*followers?\s+\d+\s*following"),
        (8, r"(Edit [Pp]rofile|Share [Pp]rofile)"),
        (8, r"Followed by \w+ and [\d,.]+[Kk]? others"),
        (6, r"(Posts|Reels|Tagged)\s+(Posts|Reels|Tagged)"),
    ],
    "Instagram Story": [
        (10, r"Your story\s+\w"), (8, r"Add to your story"), (6, r"Send message\.\.\."),
        (3, r"Close Friends"),
    ],
    "Instagram DM": [
        (10, r"@\)?\s*Message\s+\w"), (8, r"Send message\.\.\.\s*CO"), (8, r"vanish\s*mode"),
    ],
    "Twitter / X": [
        (10, r"(Post your reply|Repost|Quote\s*Tweet)"), (8, r"@\w+\s*:?\s*\d+[mhd]"),
        (6, r"(x\.com|twitter\.com)"), (5, r"(tl\)?\s*\d+\s*©\s*[\d.]+[Kk]?\s*il)"),
        (4, r"(Retweet|Repost|Bookmark)"),
    ],
    "TikTok": [
        (10, r"(tiktok|TikTok)"), (8, r"(Home\s+Friends\s+Inbox\s+Profile)"),
        (6, r"(Search\s*-\s*.{3,30}\s*>)"), (6, r"(For\s*You|FYP)"),
        (5, r"(Watch full reel)"), (4, r"(Creator earns commission)"),
    ],
    "Facebook": [
        (10, r"(facebook|Facebook)\s"), (8, r"(Like\s+Q?\s*Comment.{0,10}Share)"),
        (6, r"(fb\.com|Home Video Marketplace)"), (6, r"People you may know"),
        (5, r"Comment as \w"),
    ],
    "Reddit": [
        (10, r"r/\w{3,}"), (8, r"(upvote|downvote|karma)"), (6, r"(subreddit|reddit\.com)"),
    ],
    "WhatsApp": [
        (10, r"(WhatsApp|whatsapp)"), (8, r"end-to-end encrypted"),
        (6, r"(online|last seen \w+ ago)"),
    ],
    "iMessage / SMS": [
        (10, r"(iMessage|iMESSAGE)"), (8, r"(Delivered|Read\s+\d{1,2}:\d{2})"),
        (5, r"(Text Message|SMS)"),
    ],
    "Group Chat": [
        (8, r"(joined using this group|requested to join)"),
        (6, r"(UNREAD MESSAGE|group.{0,10}invite link)"), (5, r"(\d+:\d{2}\s*(AM|PM)\s+~)"),
    ],
    "ChatGPT / AI": [
        (10, r"(ChatGPT|chatgpt)"), (8, r"(GPT-[34]|OpenAI|Claude)"),
        (6, r"(\.claude/|agents/|SKILL\.md)"),
        (5, r"(AI|Al)\s*(assistant|model|prompt|engineer)"),
    ],
    "Email / Gmail": [
        (10, r"(Gmail|gmail)"), (8, r"(Inbox|inbox).{0,20}(starred|sent|draft)"),
        (5, r"(Subject:|From:|Reply to)"),
    ],
    "Airbnb / Reviews": [
        (10, r"(Overall rating|Public review)"), (8, r"(Glamping|glamping|campsite|Airbnb)"),
        (6, r"(Check-in|Responsive host|stars?\s*\d)"),
        (5, r"(review of your place|reservation)"),
    ],
    "Real Estate": [
        (8, r"(real estate|property|auction|acreage|acres)"),
        (6, r"(mortgage|foreclosure|MLS|listing)"),
        (5, r"(bedroom|bathroom|sq\s*ft|square feet)"),
    ],
    "Music / Podcasts": [
        (10, r"(Spotify|spotify|Apple Music)"), (8, r"(Now [Pp]laying|[Pp]laying from)"),
        (6, r"(podcast|Episode\s+\d)"), (3, r"[fF][12i]\s+[\w\s]+-\s+[\w\s]+"),
    ],
    "Dating Apps": [
        (10, r"(Tinder|Hinge|Bumble|match\.com)"), (8, r"(swipe|Super Like|rose|it.s a match)"),
        (5, r"(Dating|Notifications\s+Menu)"),
    ],
    "Food / Restaurants": [
        (10, r"(UberEats|DoorDash|Grubhub|Postmates)"),
        (8, r"(reservation|Omakase|dine.in|restaurant)"),
        (6, r"(menu|appetizer|entree|dessert)"), (5, r"(delivery fee|service fee|tip\b)"),
    ],
    "Travel / Flights": [
        (8, r"(flight|boarding pass|airport|airline)"),
        (8, r"(Economy Seat|Gate\s+\w\d|Terminal\s+\d)"),
        (6, r"(hotel|hostel|resort|check.in|check.out)"),
        (5, r"(Copenhagen|Bora Bora|Venice|itinerary)"),
    ],
    "Inspirational / Quotes": [
        (5, r"(type .yes. if you agree)"), (4, r"(never give up|keep going|you can do)"),
        (3, r"(growth|healing|self.?worth|self.?love|mindset)"),
        (3, r"(relationship|partner|love|trust|respect).{5,60}"
            r"(relationship|partner|love|trust|respect)"),
        (2, r"(toxic|boundaries|ego|peace|energy|alignment)"),
        (2, r"(inspire|motivat|courage|strength|wisdom)"),
    ],
    "Astrology / Spirituality": [
        (10, r"(horoscope|birth chart|natal chart|zodiac)"),
        (8, r"(Aries|Taurus|Gemini|Cancer|Leo|Virgo|Libra|Scorpio|Sagittarius|Capricorn"
            r"|Aquarius|Pisces)\s*:"),
        (6, r"(Moon in|Venus in|Mercury in|Saturn in)"),
        (5, r"(Nakshatra|Ascendant|planetary)"),
        (4, r"(chakra|spiritual|ceremony|sacred|shaman)"),
    ],
    "Event Festival": [
        (10, r"(Event Festival|event attendee|festival grounds)"),
        (8, r"(Black Rock|Ticket Aid|BRC)"), (5, r"(Burn|camp|radical self)"),
    ],
    "Art / Design": [
        (5, r"(sculpture|installation|gallery|exhibit)"),
        (4, r"(architect|design|Illustrator|Adobe)"),
        (3, r"(museum|curator|contemporary art)"),
    ],
    "Legal / Government": [
        (10, r"(CHARGE CODE|BOND AMOUNT|CHARGE DESCRIPTION)"),
        (8, r"(Department of|Internal Revenue|IRS|Tax Exempt)"),
        (6, r"(court|arrest|felony|misdemeanor|probation)"),
        (5, r"(license|permit|certificate)"),
    ],
    "Cannabis": [
        (10, r"(dispensary|cannabis|THC|CBD|sativa|indica)"),
        (8, r"(strain|flower|edible|concentrate)"), (5, r"(half ounce|\d+\.?\d*%\s*THC)"),
    ],
    "News": [
        (6, r"(BREAKING|EXCLUSIVE|breaking news)"),
        (5, r"(news3lv|CNN|NBC|ABC|MSNBC|Fox News)"),
        (4, r"(monolith|election|president|congress)"),
    ],
    "Vehicles / Auto": [
        (8, r"(SHERP|UTV|off-road|4x4)"), (6, r"(truck|SUV|vehicle|wrapping|racing)"),
        (5, r"(Slate|EV|electric vehicle|Tesla)"),
    ],
    "Phone Settings": [
        (10, r"(Settings\s+Wi-?Fi|Wi-Fi\s+Settings)"),
        (8, r"(Bluetooth|Cellular|Airplane Mode)"),
        (6, r"(Ask to Join Networks|Auto-Join Hotspot)"),
    ],
    "Domain Names": [
        (10, r"(Expires on|domain|registrar|WHOIS)"), (8, r"\w+\.\w+\s+Expires"),
    ],
    "Meme / Humor": [
        (6, r"(meme|funny|lol|lmao|bruh|bro)"), (4, r"(challenges? you|dare you)"),
    ],
    "Facebook Messenger": [
        (10, r"(Messenger|messenger).{0,20}(facebook|mobile\.facebook)"),
        (8, r"mobile\.facebook\.com"), (6, r"(Chat Heads|Messenger Rooms)"),
    ],
    "Drone / Camera": [(10, r"(DJI|dji)[\s_]"), (6, r"(drone|aerial|GoPro)")],
    "Business / Sponsorship": [
        (8, r"(SPONSORSHIP|sponsorship|partnership)"),
        (6, r"(COMPREHENSIVE REPORT|proposal|pitch deck)"),
        (5, r"(billboard|renewal|invoice|contract)"),
    ],
    "Festival / Events": [
        (6, r"(festival|concert|garbicz|coachella|sxsw)"),
        (5, r"(lineup|stage|tent|camp|dome)"),
    ],
}
# Fixed value: from this weight on a pattern first looks at the text as written.
AS_WRITTEN_WEIGHT = 8
# Extra signals used when the best detailed score stays below 3.
FALLBACK_RULES = {
    "Instagram Post": [
        (5, r"^.{0,50}(Add comment)"), (4, r"(Liked by|Explore|Follow)"), (3, r"@\w{3,}"),
    ],
    "Instagram DM": [(6, r"(Send message|send message)"), (5, r"Message \w+\.\.\.")],
    "Instagram Story": [(8, r"Your story"), (5, r"Close Friends")],
    "TikTok": [
        (5, r"(Home\s+Friends.{0,10}Profile|Home\s+.*Profile)"), (4, r"Search\s*-"),
    ],
    "Facebook": [(5, r"(facebook\.com|d>\s*Like)")],
}

# Category families of the roll-up report.
FAMILIES = {
    "Instagram_Posts": "Instagram", "Instagram_Profiles": "Instagram",
    "Instagram_Messages": "Instagram", "Instagram_Stories": "Instagram",
    "iMessage_Chats": "Messaging", "WhatsApp_Chats": "Messaging",
}

# Full-line patterns of phone screen furniture, matched without regard to case.
CHROME_LINES = [
    r"\d{1,2}:\d{2}\s*[=\-]?\s*[ao]?[lti!]*\s*(?:5G\+?|LTE|4G|Wi-?Fi)\s*[@&GC()\s]*",
    r"\b[aA]{2}\s*[@&]\s*",
    r"[A-Z]\s+Q\s+[GCS©()\s]+",
    r"[A-Z]\s+[CQ]\s+[©()\s]+\s*[pP@]?\s*",
    r"\s*(ft|Home)\s+(Friends\s+)?(Inbox\s+)?Profile\s*",
    r"\s*©?\s*\d*\s*",
]
# Fixed value: the search text on a saved result page.
SEARCH_QUERY = r"Q\.?\s*(.{3,60}?)\s*(G\s*@|&|All\s+Images)"
