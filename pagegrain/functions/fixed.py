"""Fixed values the results depend on: word lists, patterns and thresholds.

Fixed values: everything in this module is data that must be exactly as it is for results to come out right.
Patterns are written for Java's regular expressions. No logic lives here.
"""

from __future__ import annotations


def _w(text: str) -> list[str]:
    return text.split()


# ---- words -----------------------------------------------------------------
STOPWORDS = _w("the and for with from new used buy sale cheap best near all any www com html")
QUERY_FILLER = _w(
    "news latest recent recently today tonight yesterday update updates week weeks month months year years day days "
    "this that these those what which who whom when where why how are was were has have had does did can will about "
    "into over after before between your you their there them than then also just some more most very now current "
    "currently top breaking report reports headlines happening happened past last should would could not"
)
PLATFORM_WORDS = _w(
    "github gitlab repo repos repository repositories library libraries package packages crate crates module modules "
    "source code sdk docs documentation official website site homepage pypi npm"
)
WEAK_WORDS = _w(
    "use uses using used make makes making made create creates creating created get gets getting set sets setting do "
    "does doing write writes writing add adds adding run runs running find finds need needs want wants work works "
    "working best good simple easy example examples tutorial tutorials guide guides way ways paper papers preprint "
    "preprints arxiv announcement announcements announce announces announced press release releases launch launches "
    "launched newest official product products wrote written invented founded painted composed discovered built "
    "developed proposed formulated directed designed created"
)
GENERIC_CAPS = _w(
    "best top new free cheap good easy simple fast how install compare comparison fix build create learn use using "
    "get find make setup set configure run write read buy download guide tutorial review reviews list tips ideas why "
    "is does do can should the a an show give tell"
)
CONNECTORS = _w("of the de la")
CORPORATE_SUFFIXES = _w("inc corp corporation ltd llc holdings group technologies labs ai co plc se ag")
SECOND_LEVEL = _w("co com org net gov edu ac or ne")
TAIL_SECOND_LEVEL = _w("co com net org gov edu ac ne or go")
BRAND_SECOND_LEVEL = _w("co com org net gov govt ac")
NEWSY = _w(
    "news latest recent recently today tonight yesterday announcement announcements announce announced announces "
    "release releases released paper papers post posts article articles launch launches launched headline headlines "
    "update updates breaking published preprint preprints"
)
CODE_WORDS = _w("github gitlab bitbucket repo repos repository repositories library libraries package packages crate "
                "crates pypi npm sdk")
ANNOUNCE_WORDS = _w("news latest announcement announcements announce announced announces launch launches launched "
                    "headline headlines breaking press today yesterday recent recently")
PAPER_WORDS = _w("paper papers preprint preprints arxiv research study studies survey surveys")
REPO_WORDS = _w("github gitlab bitbucket codeberg repo repos repository repositories")
ASKS = {
    "policy": _w("policy policies terms privacy legal tos gdpr cookie cookies license licence"),
    "stock": _w("stock stocks share shares price prices quote quotes ticker"),
    "docs": _w("docs documentation release releases changelog notes api reference guide tutorial manual readme version "
               "versions"),
    "security": _w("security vulnerability vulnerabilities cve advisory advisories exploit patch"),
}
OPINION = _w("best top vs versus review reviews cheap cheapest buy deals deal recommend recommended alternatives "
             "alternative tutorial course courses coupon discount")
EXAMPLE_TOKENS = _w("demo demos example examples sample samples template templates starter starters boilerplate "
                    "tutorial tutorials benchmark benchmarks awesome")
NEED_NOUNS = _w("library libraries lib libs package packages module modules crate crates sdk sdks framework frameworks "
                "toolkit toolkits client clients")
GUIDE_ASKED = _w("guide tutorial tutorials how learn beginner beginners intro introduction")
FORGE_HOSTS = _w("github.com gitlab.com bitbucket.org codeberg.org")

# ---- search-result URL kinds ------------------------------------------------
SEARCH_SEGMENTS = _w("search searchresults results find query")
SEARCH_KEYS = _w("q query search s keyword keywords term search_query")
LISTING_SEGMENTS = _w("tag tags tagged category categories cat topic topics label labels archive archives author authors")
SECTION_SEGMENTS = _w("news blog blogs articles posts products shop store stories videos reviews forum forums community "
                      "latest trending popular all index home default about about-us company")
INDEX_SEGMENTS = _w(
    "new news newsroom press press-releases press-release-archive releases release-notes changelog announcements "
    "updates headlines blog blogs articles stories archive archives category categories tag tags topics latest "
    "whats-new insights media events news-types overview financials filings sec-filings quarterly-results results "
    "presentations governance careers pricing platform services products solutions signin sign-in login account "
    "support help c"
)
LISTING_KEYS = _w("l page pagenum page_num per_page perpage offset limit")
FORGE_RESERVED = _w("topics trending orgs collections marketplace sponsors features explore settings about pricing "
                    "enterprise apps login signup events readme customer-stories solutions resources")
STRONG_TOKENS = _w("news newsroom press releases notes changelog announcements updates headlines blog blogs articles "
                   "stories archive archives categories tags topics latest insights media events types")
INDEX_TOKENS = STRONG_TOKENS + _w("new release note announcement update headline article story category tag topic whats "
                                  "insight event type and")
ID_KEYS = _w("id p v item story article post tid t pid sku")
ARTICLE_SECTIONS = _w("news newsroom press press-releases press-release news-releases blog blogs stories story "
                      "announcements announcement releases release articles article updates update insights media")
MARKETING_SEGMENTS = _w("brc resources resource learn business-resources help support guides guide academy")
CHALLENGE_MARKS = [
    "just a moment", "attention required", "access denied", "verify you are human", "are you a robot", "captcha",
    "security check", "checking your browser", "403 forbidden", "404 not found", "page not found", "enable javascript",
    "ddos protection", "robot check", "pardon our interruption", "unusual traffic", "request blocked",
]

# ---- page URL kinds ----------------------------------------------------------
QUERY_KEYS = _w(
    "q query k s st ss search searchterm keyword keywords text term searchtext find_desc d field-keywords kw _nkw "
    "search_string search_key search_query searchquery words freetext sw ntt qs wd searchkeyword searchkeywords "
    "busqueda buscar suche suchbegriff recherche zoekterm zoeken ricerca cerca pesquisa busca szukaj sok haku hledat"
)
PATH_GENERIC = _w("search s q jobs job results result shop browse category categories c list html htm php aspx for sale "
                  "buy rent homes products product items all new used in near w")
SERVICE_HOSTS = _w("help support blog blogs careers jobs account accounts login auth signin investors investor ir press "
                   "news status docs developer developers community forum forums about corporate legal privacy m mobile "
                   "cdn static assets img images media")
URL_FILLER = _w("html htm php aspx jsp index default item items product products detail details page pages www en us au "
                "uk gb ca nz de fr es it nl dp view listing listings")
OPTION_VALUES = _w("true false yes no asc desc ascending descending price relevance newest oldest popular rating grid "
                   "list all any default best date name score featured json html")
TERM_GENERIC = _w("search results result html htm php aspx query catalogsearch buscar zoeken recherche suche annonser "
                  "annunci anuncios jobs job shop browse catalog products product list category directory www")
SEARCH_PATH = (r"(?i)/(search|s|shop|catalogsearch|browse|category|categories|c|list|jobs|homes|for_sale|sale|buy|rent|"
               r"pdsearch|keyword\.php|w|p/pl)(/|$|\.|\?)")
ITEM_MARKER = (r"(?i)/(p|dp|ip|item|itm|items|product|products|listing|listings|rooms|property|properties|job|jobs|"
               r"viewjob|questions|ad|ads|deal)/[^/]+")
NOT_ITEM = (r"(?i)\.(css|js|mjs|json|xml|pdf|png|jpe?g|gif|svg|webp|ico|woff2?|ttf)$|(privacy|policy|policies|terms|"
            r"conditions|statement|legal|cookie|customer-service|customer-care|help|faq|support|careers|about|ethics|"
            r"disclosure|accessibility|sitemap|store-locator|stores|gift-card|login|sign-?in|register|account|contact|"
            r"returns|shipping|delivery)")
LONG_ID = r"\d{5,}|[A-Z0-9]{8,}"
VERSION_SEGMENT = r"(?i)^(?:v?\d+(?:[._]\d+)*|current|latest|stable|master|main|dev)$"
NOT_PAGES = (r"(?i)\.(jpe?g|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|zip|gz|tgz|rar|7z|mp4|webm|mov|mp3|wav|ogg|"
             r"woff2?|ttf|eot|exe|dmg|apk|iso)$")
CREDENTIAL_KEYS = _w("access_token accesstoken auth auth_token authorization code csrf csrf_token fb_dtsg id_token jazoest "
                     "key password passwd pwd refresh_token session session_id sessionid sid token xsrf xsrf_token")
TRACK_CANONICAL = r"(?i)^(utm_|fbclid$|gclid$|mc_|ref$|ref_|igshid$|cmpid$|spm$)"
TRACK_PAGE_KEY = r"(?i)^(utm_|fbclid|gclid|ref$|ref_|mc_|cmpid|ocid|taid)"
TRACK_RESULT_KEY = r"(?i)^(utm_|fbclid|gclid|ref=|ref_|mc_)"
LOCALE = r"^[a-z]{2}(?:[-_](?:[a-z]{2}|[a-z]{4}|\d{3}))?$"
BENCH_LOCALE = r"^[a-z]{2}[-_][a-zA-Z]{2}$"
BENCH_LISTING_WORDS = _w("news blog blogs press newsroom articles archive archives category categories tag tags topic "
                         "topics search index latest releases stories updates announcements press-releases media "
                         "insights events home papers trending main_page list feed all")
BENCH_LISTING_PARENTS = _w("tag tags category categories topic topics archive archives search page author authors label "
                           "labels feed")
BENCH_LISTING_QUERY = _w("q s query search page p paged")
AD_HOST = (r"(?i)(?:^|\.)(?:ad|ads|adclick|adserver|sponsored-ads|sponsored|clickserve|doubleclick|googleadservices|"
           r"adsrvr|adnxs|criteo|taboola|outbrain)[\w-]*\.")
AD_PATH = r"(?i)/(?:aclk|adclick|clk|click|pagead|sspa/click|sponsored)(?:/|\?|$)"
CC_TLDS = _w("io ai co me tv fm ly to us uk au nz ca de fr jp in eu nl se no ch es it br mx kr cn ru pl dk fi ie be at sg "
             "hk za")
FILE_TLDS = _w("html htm json yaml yml toml txt pdf png jpg jpeg gif svg docx xlsx pptx zip tar gzip md csv xml php asp "
               "aspx jsp exe dll bat java rust lock conf cfg ini log")
SITE_STOP = _w("a an the of on for and or in to from with by about at is are new newest latest recent recently news post "
               "posts blog update updates site website page pages")
MONTHS = _w("jan feb mar apr may jun jul aug sep oct nov dec")
RECENCY_DAYS = {"day": 1, "week": 7, "month": 31, "year": 366}

# ---- text -------------------------------------------------------------------
CONSENT = (r"(?i)\b(cookies?|consent|accept all|reject all|privacy settings|manage preferences|we use cookies|"
           r"your privacy)\b")
MD_LINK = r"!?\[([^\]]*)\]\(([^)]*)\)"
SENTENCE_END = r"""[.!?…:;)"'”’*_\]]$"""
FOOTER = (r"(?i)(©|\(c\) ?\d{4}|copyright|all rights reserved|terms (of|and) (use|service|conditions)|"
          r"privacy (policy|notice|statement)|sign up for (our|the)|subscribe to (our|the)|newsletter|"
          r"registered (office|in england|company)|company (number|no\.?|registration))")
NAV_TOKEN = (r"(?i)^[\W_]*(menu|home|search|sign[ -]?in|sign[ -]?up|log[ -]?in|log[ -]?out|register|subscribe|"
             r"skip to [\w ]+|cart|basket|account|close|open menu|toggle[\w ]*|main navigation|navigation|more|"
             r"back to top|accept( all)?|reject( all)?|contact( us)?|about( us)?|help|share|follow us|language|en|"
             r"menu close)[\W_]*$")
LISTING_PATH = (r"(?i)/(index|archives?|directory|sitemap|contents|toc|tags?|topics|categories|category|catalog|"
                r"catalogue|browse|all|list|lists|glossary|a-z)(/|$|\.)")
PAGE_PRICE = (r"(?:A\$|AU\$|US\$|C\$|NZ\$|\$|€|£)\s?\d[\d,]*(?:\.\d{2})?"
              r"|(?<![\w.,])\d{1,3}(?:[.\s ]\d{3})*(?:,\d{2}|,-)?\s?(?:€|EUR|kr|zł|Kč|Ft|CHF|lei|лв)(?!\w)")
# Every price of the pattern above holds one of these.
PRICE_MARKERS = ("$", "€", "£", "EUR", "kr", "zł", "Kč", "Ft", "CHF", "lei", "лв")
ZERO_PRICE = r"^\D*0+(?:[.,]0+|,-)?\D*$"
UNRENDERED = r"\{\{\s*[\w.$]+\s*\}\}|\$\{\s*[\w.]+\s*\}|\b(?:NaN|undefined)\b|\[object Object\]"
INTERACTION_GATE = (r"(?i)\b(?:select|choose|pick|enter|add)\b[^.!?]{0,80}?\bto (?:see|view|get|show|check)\b"
                    r"[^.!?]{0,30}?\b(?:prices?|pricing|rates?|fares?|availability|cost|quotes?)\b")
EMPTY_LISTING = (r"(?i)\b(?:no products (?:are )?(?:available|found|to show|in this (?:collection|category))"
                 r"|there are no products(?: listed)?(?: in this (?:collection|category))?"
                 r"|this (?:collection|category) is (?:currently )?empty"
                 r"|no (?:products|items) (?:match|matched) your (?:search|selection|filters?)"
                 r"|0 (?:products|items) found)\b")
PAYWALL = (r"(?i)(unlock (this|the) (story|article)|subscribe (now )?to (continue|keep) reading|to (continue|keep) "
           r"reading,? (please )?(subscribe|sign in|log in|register)|already a subscriber|this (article|story|content) "
           r"is (only )?(available )?(to|for) (subscribers|members)|subscribers? only|create a free account to "
           r"(continue|read))")
NOT_FREE = r"""["']isAccessibleForFree["']\s*:\s*["']?(false|False)"""
ARTICLE_TYPES = _w("Article NewsArticle BlogPosting Report ScholarlyArticle AnalysisNewsArticle OpinionNewsArticle "
                   "ReviewNewsArticle TechArticle LiveBlogPosting")
ARTICLE_PATH = (r"(?i)/(news|article|articles|story|stories|blog|blogs|post|posts|opinion|insights?|press|"
                r"media-releases?|press-releases?)/|/20\d\d/\d{1,2}/")
OG_ARTICLE = r"""(?i)<meta[^>]+property=["']og:type["'][^>]+content=["']article"""
JSON_PREFIX = r"^[﻿ \t\r\n]*(?:for \(;;\);|for\(;;\);|\)\]\}'|while\(1\);|while \(1\);|&&&START&&&)[,\r\n ]*"
STOCK_BLURB_TICKER = r"\((?:[A-Z]{2,8}\s*:\s*)?[A-Z]{1,6}(?:[.-][A-Z])?\)"
STOCK_BLURB_MARKET = (
    r"(?i)\b(?:outperform(?:s|ed|ing)?|underperform(?:s|ed|ing)?|trending stocks?|investors heavily search|stock moves?|"
    r"(?:shares?|stocks?) (?:rise|rises|rose|fall|falls|fell|jump|jumps|jumped|drop|drops|dropped|surge|surges|surged|"
    r"slip|slips|slipped)|price targets?|broader market|here(?:'s| is) what you need to know)\b")
STOCK_BLURB_TRADING = (r"(?i)\b(?:stocks?|shares?|investors?|market|trading|moved (?:up|down)|here(?:'s| is) why|"
                       r"why it'?s moving|\d+(?:\.\d+)?%)")
STOCK_BLURB_PHRASE = (r"(?i)\b(?:buying opportunity|attracting investor attention|why it'?s moving|"
                      r"stock (?:sinks|soars|plunges|climbs|slides|tumbles|rallies)|"
                      r"shares (?:sink|soar|plunge|climb|slide|tumble|rally)|moved (?:up|down) by \d)")

# ---- price scan --------------------------------------------------------------
CURRENCY_PREFIX = [("AU$", "AUD"), ("A$", "AUD"), ("US$", "USD"), ("NZ$", "NZD"), ("CA$", "CAD"), ("C$", "CAD"),
                   ("HK$", "HKD"), ("S$", "SGD"), ("R$", "BRL"), ("AUD", "AUD"), ("USD", "USD"), ("NZD", "NZD"),
                   ("CAD", "CAD"), ("EUR", "EUR"), ("GBP", "GBP"), ("£", "GBP"), ("€", "EUR"), ("₹", "INR"),
                   ("$", None), ("¥", None)]
CURRENCY_SUFFIX = [("€", "EUR"), ("kr", None), ("zł", "PLN"), ("Kč", "CZK")]
PRICE_NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\s*\.\s*\d{1,2}(?!\d))?"
WAS_BEFORE = (r"(?is)(?:\bwas|\brrp|\blist(?:\s+price)?|\breg(?:ular)?(?:\s+price)?|\boriginal(?:ly)?|\bretail|"
              r"\bcompare\s+at|\breduced\s+from|\bbefore|\busually|\bstrike)\W{0,4}\z")
WAS_AFTER = r"(?is)^\W{0,3}(?:rrp|list\s+price)\b(?![\s:]{0,4}(?:[$£€₹]|[A-Z]{1,3}\s?\$|\d))"
SAVE_BEFORE = r"(?is)\b(?:save|saving|you\s+save|discount)\W{0,4}\z"
SAVE_AFTER = r"(?is)^\s*(?:off\b|discount\b)"
THRESHOLD_BEFORE = r"(?is)(?:\bover|\babove|\bspend|\bmin(?:imum)?|\boff|\borders?\s+of|\bafter|\+)\W{0,3}\z"
THRESHOLD_AFTER = r"(?is)^\W{0,3}(?:(?:min(?:imum)?\s+)?spend|or\s+more|and\s+over)\b"
FEE_AFTER = (r"(?is)^\W{0,3}(?:shipping|postage|delivery\s+fee|p&p|per\s+month|/\s*mo|a\s+month|pm\b)"
             r"|^\s*/\s*\d*\s*(?:k?g|m?l|oz|lb|ea|each|unit|item|piece|pc)\b")
LABEL_EDGE_WORDS = "from|was|now|only|just|rrp|save|delivered|shipped|each|for|at|and|or|plus|with|in"
# Any number of such words at either end.
LABEL_EDGE = rf"(?i)^(?:(?:{LABEL_EDGE_WORDS})\b\W*)+|(?:\W*\b(?:{LABEL_EDGE_WORDS}))+$"

# ---- other card facts --------------------------------------------------------
EXPIRED = r"(?i)\b(?:expired|deal\s+(?:has\s+)?ended|offer\s+ended|no\s+longer\s+available)\b"
OUT_OF_STOCK = (r"(?i)\b(?:out\s+of\s+stock|sold\s*out|unavailable|not\s+available|no\s+stock|backorder(?:ed)?|"
                r"pre-?order)\b|\b0\s+(?:units?|unit\(s\)|left|in\s+stock)\b")
LIMITED = (r"(?i)\b(?:only\s+\d+\s+left|\d+\s+left\s+in\s+stock|low\s+stock|limited\s+stock|few\s+left|almost\s+gone|"
           r"selling\s+fast)\b")
IN_STOCK = r"(?i)\b(?:in\s+stock|available\s+now|in\s+store|ready\s+to\s+ship|\d+\s+units?\b|\d+\s+unit\(s\))"
STOCK_COUNT = (r"(?i)(?<![$\d.,])\b(?:only[ \t]+)?(\d{1,5})[ \t]+(?:units?\b|unit\(s\)|left\b|(?:items?[ \t]+)?in[ \t]+"
               r"stock\b|available\b)|\bstock[ \t:]{0,3}(\d{1,5})\b")
MONTH_NAME = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
DATE_MENTION = (r"(?i)\b(?:\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?"
                rf"|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH_NAME},?\s+\d{{4}}"
                rf"|{MONTH_NAME}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}"
                r"|\d{1,2}/\d{1,2}/\d{4}"
                r"|(?:\d+|an?)\s+(?:second|minute|min|hour|hr|day|week|month|year)s?\s+ago"
                r"|(?:posted|listed|updated|added)\s+(?:today|yesterday))\b")
RATING = (r"(?i)(?:\b(\d(?:\.\d)?)\s*(?:out\s+of\s+5|/\s*5\b)(?:\s*stars?)?|\b(\d\.\d)\s+stars?\b|★\s*(\d(?:\.\d)?)\b"
          r"|\brat(?:ing|ed)\W{0,3}(\d(?:\.\d)?)\b)")
COUNTED = (r"(?i)\(?\b(\d{1,3}(?:,\d{3})+|\d+)\)?\s+(reviews?|ratings?|comments?|votes?|answers?|replies|views|"
           r"applicants|bids|sold)\b")
LOCATION_LABEL = r"(?im)(?:^|\|)\s*(?:location|based\s+in|📍)\s*:?\s*([^\n|]{2,60})"
PLACE_LINE = (r"(?m)^[ \t]*((?:Remote|Hybrid)\b[^\n\d]{0,30}|[A-Z][a-z'.-]+(?:[ \t][A-Z][a-z'.-]+){0,3},[ \t]*[A-Z]{2,3}"
              r"(?:[ \t]\d{4,5})?)[ \t]*$")
AD_LABEL = r"(?im)^\s*(?:sponsored(?:\s+ad)?|advertisement|promoted|ad)\s*$"
NOT_ITEM_LINK = (r"(?i)login|log-in|signin|sign-in|account|register|wishlist|cart|checkout|privacy|terms|contact|help|"
                 r"faq|about")
BUTTON = (r"(?i)^(?:add\s+to\s+(?:cart|basket|wishlist)|buy(?:\s+now)?|view(?:\s+details)?|details|compare|more|"
          r"read\s+more|shop\s+now|apply(?:\s+now)?|save|share|special|sale|new|hot)\W*$")
RECORD_LINK = r'(!?)\[((?:[^\[\]]|\[[^\[\]]*\](?:\([^)]*\))?)*)\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)'
RECORD_IMAGE = r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)"
NUMERIC_KINDS = _w("price was_price date rating count stock_count")

# ---- walls and error pages -----------------------------------------------------
CHALLENGE_TITLES = [
    "just a moment...", "attention required! | cloudflare", "access denied", "verify you are human", "robot or human?",
    "pardon our interruption", "security check", "access to this page has been denied", "prove your humanity",
    "human verification", "are you a human?", "are you human?", "one more step", "bot verification",
    "verify you're human", "please wait while we verify your browser", "zugriff verweigert", "accès refusé",
    "acces refuse", "acceso denegado", "accesso negato", "toegang geweigerd", "åtkomst nekad", "adgang nægtet",
    "tilgang nektet", "pääsy estetty", "dostęp zabroniony", "přístup odepřen", "hozzáférés megtagadva",
    "доступ ограничен", "доступ запрещён", "доступ запрещен", "アクセスが拒否されました", "访问被拒绝", "拒绝访问",
    "access blocked", "request blocked", "you have been blocked", "sorry, you have been blocked",
    "vercel security checkpoint", "ddos protection", "checking your browser",
]
CHALLENGE_PHRASES = [
    "verify you are human", "checking your browser before accessing", "enable javascript and cookies to continue",
    "please complete the following challenge", "we must verify your session", "activate and hold the button",
    "press & hold", "press and hold", "pardon our interruption", "are you a robot", "robot or human",
    "checking if the site connection is secure", "verifying you are human", "access to this page has been denied",
    "request unsuccessful. incapsula", 'thinks you are a "bot"', "thinks you are a bot",
    "unusual traffic from your computer", "please verify you are a human", "confirm you are not a robot",
    "prove your humanity", "but not for bots", "verify you're human", "verify you're not a robot",
    "complete the security check to access", "help us verify you're a real person", "the requested url was rejected",
    "your support id is", "you don't have permission to access", "aus sicherheitsgründen mussten wir den zugriff",
    "доступ ограничен: проблема с ip", "vercel security checkpoint", "we have detected unusual activity",
]
SIGN_IN_PHRASES = [
    "sign in to continue", "log in to continue", "login to continue", "please sign in", "please log in",
    "sign in to view", "log in to view", "ingresa a tu cuenta", "inicia sesión para continuar",
    "faça login para continuar", "entre na sua conta", "connectez-vous pour continuer", "identifiez-vous",
    "bitte melden sie sich an", "melden sie sich an, um", "accedi per continuare", "log in om verder te gaan",
    "请登录", "请先登录", "登录后查看", "登录后才能", "請登入", "請先登入", "登入後查看", "ログインしてください",
    "ログインが必要です", "로그인해 주세요", "로그인이 필요합니다", "войдите в аккаунт", "войдите, чтобы продолжить",
]
BOT_PAGE_PATH = (r"(?i)/(captcha|bots?|blocked|block|challenge|access[-_]?denied|are-?you-?(human|a-?robot)|robot-?check|"
                 r"punish)(\.html?|/|$)")
SIGN_IN_PATH = r"(?i)(^|[/._-])(sign-?in|log-?in|auth|ws/ebayisapi\.dll)([/._?-]|$)"
HOME_ALIASES = r"(?i)^/?((index|default|home)(\.\w+)?)?/?$"
LOGIN_TITLE = (r"(?i)^(log ?in|sign ?in|login|log into .{1,40}|sign in to .{1,40}|log in to .{1,40}|"
               r"log in or sign up.*|sign up or log in.*)$")
LOGIN_WORDS = ["log in", "log into", "sign in", "login"]
BROWSER_ERROR = (r"(?i)\b(ERR_[A-Z0-9_]{4,}|NS_ERROR_[A-Z_]+)\b|this site can.t be reached|unable to connect|"
                 r"hmm\. we.re having trouble finding that site")
MAINTENANCE = (r"(?i)\b(down for maintenance|under maintenance|scheduled maintenance|we.ll be back (soon|shortly)|"
               r"we are currently (performing|undergoing) maintenance|currently working on [a-z0-9.-]+\.[a-z]{2,}|"
               r"temporarily unavailable|site is temporarily down)\b")
ERROR_PAGE_PATH = (r"(?i)/(error|errors|errorpage|error-page|error_page|404|not-?found|page-?not-?found|pagenotfound)"
                   r"(\.aspx|\.html?|\.php|\.jsp|/|$)")
ERROR_TITLES = [
    "error", "404", "404 error", "404 not found", "not found", "page not found", "404 - page not found",
    "404 page not found", "error 404", "an error has occurred", "an error occurred", "something went wrong",
    "server error", "oops! something went wrong", "sorry, something went wrong", "page cannot be found",
    "the page cannot be found", "this page isn't available", "this page could not be found", "page unavailable",
]
NOT_FOUND_TITLES = ["404", "404 error", "404 not found", "404 page not found", "404 - page not found", "error 404",
                    "page not found"]
ERROR_PHRASES = [
    "the page you requested could not be found", "the page you are looking for could not be found",
    "the page you were looking for doesn't exist", "the page you're looking for doesn't exist",
    "the page you are looking for does not exist", "an unexpected error has occurred",
    "we couldn't find the page you were looking for", "this page doesn't exist",
]
COMPARE_BLOCK_MARKERS = ["just a moment", "attention required", "verify you are human", "are you a robot",
                         "checking your browser", "access denied", "request blocked", "unusual traffic",
                         "pardon our interruption", "enable javascript", "client challenge"]
BENCH_TITLE_CHALLENGE = (
    r"(?i)just a moment|attention required|are you a robot|robot check|captcha|access denied|verify you are human"
    r"|page not found|security check|pardon our interruption|request blocked|^\W*(not found|forbidden|error)\W*$"
    r"|\b(?:40[0-9]|410|50[0-9])\b.{0,20}(?:not found|forbidden|error|unavailable)")
BENCH_BODY_CHALLENGE = [
    "verify you are human", "verifying you are human", "checking your browser", "enable javascript and cookies",
    "unusual traffic from your", "access to this page has been denied", "pardon our interruption", "press & hold",
    "captcha", "page not found", "404 not found", "this page doesn't exist", "this page does not exist",
    "request blocked", "are you a robot", "just a moment",
]
BENCH_PRICE = r"(?:A\$|AU\$|AUD\s?|\$|€|£)\s?\d[\d,.\s]*|\d[\d\s.,]*\s?(?:€|EUR\b)"
BENCH_MIN_CHARS = {"listing": 300, "search": 500, "article": 800, "pdf": 100}

# ---- page metadata -------------------------------------------------------------
META_DATES = _w("article:published_time og:article:published_time datepublished date dc.date dc.date.issued "
                "dcterms.date citation_publication_date citation_date citation_online_date publish-date pubdate "
                "parsely-pub-date sailthru.date publication_date article.published og:published_time")
FEED_TYPES = _w("application/rss+xml application/atom+xml application/feed+json application/json application/rdf+xml "
                "text/xml application/xml")
BOILERPLATE_TAGS = _w("script style noscript svg nav header footer aside form iframe template button dialog")
BOILERPLATE_ROLES = _w("navigation banner contentinfo complementary search dialog alertdialog menu menubar")
BOILERPLATE_WORDS = (
    r"(?i)(^|[\s_-])(nav|navbar|menu|footer|header|masthead|sidebar|side-bar|breadcrumbs?|cookie|consent|gdpr|banner|"
    r"share|sharing|social|related|recommend|newsletter|subscribe|signup|promo|advert|ads?|sponsor|popup|modal|overlay|"
    r"comments?|skip|toolbar|pagination|outbrain|taboola)([\s_-]|$)")
CLIENT_TEMPLATE = (
    r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?text/(?:template|x-template|html|x-handlebars(?:-template)?|"
    r"x-mustache(?:-template)?|x-tmpl|x-jsrender|x-underscore-template)[\"']?[^>]*>(.*?)</script>")
SCHEMA_SYNONYMS = {
    "name": _w("name headline title meta:og:title meta:twitter:title"),
    "title": _w("headline name title meta:og:title meta:twitter:title"),
    "headline": _w("headline name meta:og:title"),
    "description": _w("description abstract meta:og:description meta:description meta:twitter:description"),
    "price": _w("offers.price offers.lowPrice offers.priceSpecification.price price lowPrice "
                "meta:product:price:amount meta:og:price:amount"),
    "currency": _w("offers.priceCurrency priceCurrency offers.priceSpecification.priceCurrency "
                   "meta:product:price:currency meta:og:price:currency"),
    "pricecurrency": _w("offers.priceCurrency priceCurrency meta:product:price:currency"),
    "availability": _w("offers.availability availability meta:product:availability"),
    "image": _w("image.url image thumbnailUrl meta:og:image meta:twitter:image"),
    "images": _w("image image.url meta:og:image"),
    "url": _w("url mainEntityOfPage.@id @id meta:og:url"),
    "brand": _w("brand.name brand manufacturer.name"),
    "sku": _w("sku mpn productID"),
    "gtin": _w("gtin13 gtin gtin12 gtin14 gtin8"),
    "rating": _w("aggregateRating.ratingValue reviewRating.ratingValue"),
    "ratingcount": _w("aggregateRating.ratingCount aggregateRating.reviewCount"),
    "reviewcount": _w("aggregateRating.reviewCount aggregateRating.ratingCount"),
    "author": _w("author.name author creator.name meta:author meta:article:author"),
    "published": _w("datePublished uploadDate dateCreated meta:article:published_time meta:og:article:published_time "
                    "meta:date"),
    "datepublished": _w("datePublished uploadDate meta:article:published_time"),
    "modified": _w("dateModified meta:article:modified_time meta:og:updated_time"),
    "updated": _w("dateModified meta:article:modified_time meta:og:updated_time"),
    "publisher": _w("publisher.name publisher meta:og:site_name"),
    "sitename": _w("meta:og:site_name publisher.name"),
    "category": _w("category articleSection meta:article:section"),
    "keywords": _w("keywords meta:keywords meta:article:tag"),
    "location": _w("location.name location.address.addressLocality address.addressLocality "
                   "jobLocation.address.addressLocality contentLocation.name"),
    "address": _w("address.streetAddress location.address.streetAddress address"),
    "city": _w("address.addressLocality location.address.addressLocality jobLocation.address.addressLocality"),
    "country": _w("address.addressCountry location.address.addressCountry jobLocation.address.addressCountry"),
    "telephone": _w("telephone contactPoint.telephone"),
    "email": ["email"],
    "startdate": ["startDate"],
    "enddate": ["endDate"],
    "company": _w("hiringOrganization.name organization.name publisher.name"),
    "salary": _w("baseSalary.value.value baseSalary.value.minValue baseSalary.value estimatedSalary"),
    "duration": _w("duration timeRequired"),
    "language": _w("inLanguage meta:og:locale"),
}
LIST_ROLES = {
    "name": _w("name title productName product_name displayName display_name jobTitle headline label itemName"),
    "url": _w("url href link permalink canonicalUrl canonical_url productUrl product_url pdpUrl seoUrl uri path"),
    "price": _w("price salePrice sale_price currentPrice current_price finalPrice lowPrice amount value formattedPrice "
                "displayPrice priceValue"),
    "image": _w("image imageUrl image_url thumbnail thumbnailUrl img picture primaryImage mainImage images"),
}
LIST_WEIGHTS = {"name": 3, "url": 2, "price": 2, "image": 1}
LIST_NESTS = _w("item product offers offer price prices pricing priceInfo media images image attributes node listing data "
                "current 0")
CHROME_KEY = (r"(?i)(facet|filter|refine|nav|menu|breadcrumb|crumb|footer|header|consent|cookie|categor|brand|sort|"
              r"banner|promo|suggest|related|recent|option|recommend)")
NAV_TYPES = _w("SiteNavigationElement BreadcrumbList WPHeader WPFooter WPSideBar")
PLACE_WORDS = _w("in near at around en à a i im bei nära nær na w di")

# ---- record fields ---------------------------------------------------------------
HINT_TYPES = {"title": "string", "text": "string", "price": "number", "number": "number", "integer": "integer",
              "date": "string", "location": "string", "url": "string", "image": "string", "boolean": "boolean",
              "rating": "number", "count": "integer", "availability": "string", "currency": "string"}
SAME_WORDS = [
    _w("salary pay wage compensation remuneration package"),
    _w("location where city place venue address suburb region area"),
    _w("posted listed published date added when on"),
    _w("company employer organisation organization business brand seller maker manufacturer by"),
    _w("price cost fee amount ticket tickets admission entry"),
    _w("remote wfh home"),
    _w("type kind category format"),
    _w("stock availability available status"),
]
WAS_WORDS = _w("was rrp original list old before regular")
STOCK_WORDS = _w("stock available availability instock")
LABEL_LINE = r"^\s*([^\W\d_][\w &/().'-]{0,40}?)\s*[:：]\s*(.*?)\s*$"
TRUE_WORD = r"(?i)^(?:yes|y|true|1|✓|✔)$"
FALSE_WORD = r"(?i)^(?:no|n|false|0|✗|✘|none|n/a)$"

# ---- query intent ------------------------------------------------------------------
FACT_LEAD = (r"(?i)^\W*(?:who|whom|whose|what|when|where|which|why|how (?:many|much|old|tall|long|far|big|large|high|"
             r"often)|is|was|are|were|did|does|do)\b")
FACT_PHRASE = (r"(?i)\b(?:smallest|largest|biggest|tallest|highest|longest|deepest|oldest|youngest|fastest|capital of|"
               r"population of|president of|prime minister of|founder of|inventor of|author of|meaning of|definition of|"
               r"height of|born in|died in)\b")
_LANGS = r"(?:python|rust|golang|go|javascript|typescript|node\.js|nodejs|java|ruby|php|c\+\+|c#|swift|kotlin)"
LANG_LIB = (r"(?i)(?<![\w.+#])" + _LANGS + r"\s+(?:libraries|library|packages?|crates?|modules?|gems?|frameworks?|sdks?)"
            r"\b|(?<![\w.+#])" + _LANGS + r"(?:\s+[\w.+#-]+){1,2}\s+frameworks?\b")
LANG_SURE = r"(?i)(?<![\w.+#])(?:javascript|typescript|golang|node\.js|nodejs|php|c\+\+|c#|kotlin)(?![\w+#]|\.\w)"
LANG_AMBIGUOUS = r"(?i)(?<![\w.+#])(?:python|rust|go|java|ruby|swift)(?![\w+#]|\.\w)"
IN_LANG = r"(?i)\bin\s+(?:python|rust|go|java|ruby|swift)\b"
DISCOVERY = r"(?i)\b(?:library|libraries|framework|frameworks|sdk|sdks)\s+for\b"
NOT_SOFTWARE = _w("public school university city county national local digital state college town")
PLATFORM = (r"(?i)(?<![\w.])(?:github|gitlab|bitbucket|codeberg|npm|pypi|crates?|cargo|repo|repos|repositor(?:y|ies)|"
            r"source\s+code)(?![\w.])")
PAPERS = r"(?i)\b(?:papers?\s+(?:on|about)|research\s+on|arxiv|preprints?|survey\s+of)\b"
ANNOUNCE = r"(?i)\b(?:announce[sd]?|announcements?|press\s+releases?|launch(?:es|ed)?)\b"
NEWS_WORD = r"(?i)\b(?:news|headlines?|latest\s+on)\b"
EVENT_WORD = (
    r"(?i)\b(?:acquisitions?|acquires?|acquired|mergers?|layoffs?|lay-?offs?|job\s+cuts|funding|raises|lawsuits?|sued|"
    r"sues|data\s+breach|breach|partnerships?|earnings|ipo|appoint(?:s|ed|ment)?|resign(?:s|ed|ation)?|"
    r"chief\s+executive|ceo|recalls?|investigations?|bankruptcy|insolvency|administration|restructuring|scandal|fined)\b")
WINDOW_PHRASE = r"(?i)\b(?:this\s+week|today|tonight)\b"
QA_TRIGGER = (
    r"(?i)\b(?:how\s+to|how\s+do\s+(?:i|you|we)|how\s+can\s+i|errors?|exceptions?|tracebacks?|fix(?:ing|es)?|"
    r"stack\s*trace|segfault|not\s+working|fail(?:s|ed)?\s+(?:to|with)|cannot\s+(?:read|find|resolve)|"
    r"is\s+not\s+(?:defined|a\s+function))\b")
QA_STRONG = (r"(?i)\b(?:errors?|exceptions?|tracebacks?|stack\s*trace|segfault|cannot\s+(?:read|find|resolve)|"
             r"is\s+not\s+(?:defined|a\s+function))\b")
EXCEPTION_CLASS = r"\b[A-Z]\w*(?:Error|Exception)\b"
CODEISH = (
    r"[a-z0-9]_[a-z0-9]|[a-z][A-Z]|\(\)|::|(?<!\s)--?[a-z]{2}|\b\w+\.(?:py|js|ts|rs|go|rb|php|java|kt|swift|cpp|h|cs|"
    r"json|ya?ml|toml|sh|sql|css|html)\b|\b[a-z]+\.[a-z]+\.[a-z]+\b|\b(?:E\d{4}|ERR_\w+|0x[0-9a-f]+)\b|`|\bnull\b|"
    r"\bundefined\b|\bnpm\b|\bgit\b|\bdocker\b|\bsql\b|\bcss\b|\bhtml\b|\bapi\b|\bcompile[dr]?\b|\bsyntax\b|\bruntime\b|"
    r"\bpip\b")
REF_LEAD = (r"(?i)^\W*(?:who(?:'s|\s+is|\s+was|\s+are|\s+were|m)?|whose|what\s+(?:is|was|are|were)|what\s+year|"
            r"what\s+date|when\s+(?:was|did|is|were)|how\s+(?:tall|long|many|much|old|far|big|high|deep|wide|heavy))\b")
REF_PHRASE = (r"(?i)\b(?:capital\s+of|population\s+of|currency\s+(?:of|in)|what\s+currency|"
              r"(?:founded|invented|wrote|painted|composed|discovered))\b")
FIRST_PERSON = r"(?i)\b(?:i|i'm|i've|my|we|our)\b"
NAVIGATIONAL = r"(?i)\b(?:home\s?page|(?:official|main|web)\s?(?:site|website|page)|website)\b"
OPERATOR = r"\S+:\S*|(?<!\S)-\S+"
PHRASE_GAP = r"[\W_]+(?:(?:of|and|with|for|in|on|the|a|an|to|by)[\W_]+)?"
ASKING = _w("who whom whose what when where how which why is was are were did does do the a an")
ARTICLES = _w("the a an")
ASKED_VERBS = _w("wrote written write invented invent discovered discover founded created directed composed painted built "
                 "designed authored formed started born died won named called known")
DEGREE = _w("many much old tall long far big large high often")
PROPERTY_OF = (
    r"(?i)^(?:the\s+)?(?:(?:current|total|official|estimated)\s+)?(?:population|capital|president|prime minister|"
    r"founders?|inventor|author|meaning|definition|height|area|currency|flag|languages?|leader|ceo|director|creator|"
    r"composer|artist|age|size|length|depth|climate|monarch|anthem|motto|origin|name|symbol|formula|boiling point|"
    r"melting point)\s+of\s+(?:the\s+)?(.+)$")
DISAMBIGUATION = r"(?i)\b(?:may|can|could|might) (?:also )?refer to\b|\bdisambiguation\b"

# ---- result page types ----------------------------------------------------------------
STOCK_URL = (r"/(?:quotes?|stocks?|stock-?quotes?|stock-?prices?|share-?prices?|live-?blog|stock-market)(?:/|-|$)|"
             r"(?:share|stock)-?price|liveblog")
STOCK_TITLE = (r"(?i)\b(?:share|stock) prices?\b|\bstock quotes?\b|\blive ?blog\b|\blive blog\b|"
               r"\b(?:stocks?|shares?) (?:live|today)\b|\bstock market today\b")
POLICY_URL = (r"/(?:legal|policy|policies|terms|terms-of-service|terms-of-use|privacy|privacy-policy|tos|cookies?|gdpr|"
              r"legal-notice)(?:/|$)")
POLICY_TITLE = (r"(?i)\bterms (?:of (?:service|use)|and conditions|& conditions)\b|"
                r"\bprivacy (?:policy|notice|statement)\b|\bpolicy updates?\b|\bcookie (?:policy|notice)\b|"
                r"\blegal notices?\b|\bpolicies\b")
DOCS_URL = (r"/(?:release-?notes?|releases|changelog|change-?log|whats-?new|docs?|documentation|api|reference|"
            r"developers?|help|support|kb|knowledge-?base|status|guides?)(?:/|$)")
DOCS_HOST = _w("docs developer developers support help status api learn")
DOCS_TITLE = (r"(?i)\brelease notes?\b|\bchange-?log\b|\bapi reference\b|\bdocumentation\b|\bhelp cent(?:er|re)\b|"
              r"\buser guide\b")
ADVISORY_URL = r"/(?:security-)?advisor(?:y|ies)(?:/|$)|/cve-\d"
ADVISORY_TITLE = r"(?i)\bsecurity advisor(?:y|ies)\b|\bcve-\d{4}-\d+"
AGGREGATOR_TITLE = (r"(?i)\b(?:latest|breaking|top|all|today'?s)\s+(?:news|headlines|stories|updates)\b|"
                    r"\bnews(?:\s+and|,)\s+(?:updates|analysis|photos|videos)\b|\bnews archive\b|\bnews today\b")
LIST_URL = r"/awesome-|/(?:paper|reading)-?lists?(?:/|$)"
LIST_TITLE = (r"(?i)\bawesome[- ]|\b(?:paper|reading|curated|resource) lists?\b|\blist of (?:papers|publications)\b|"
              r"\bcollection of papers\b|\bpapers? (?:digest|roundup|weekly)\b|\bdaily papers\b")
PRESS_URL = r"/(?:news|press|newsroom|press-releases?|blog|stories|media|announcements?)/"
GUIDE_TITLE = (r"(?i)\b(?:how to|how do|guide to|a guide|beginner'?s?|tutorial|step[- ]by[- ]step|getting started|"
               r"introduction to|learn(?:ing)?)\b")
LIBRARY_TITLE = r"(?i)\b(?:libraries|library|packages?|crates?|frameworks?|modules?|sdks?|toolkits?)\b"
LIBRARY_URL = (r"/(?:packages?|project|projects|crates?|libraries|library|pkg)(?:/|$)|^(?:pypi\.org|crates\.io|"
               r"npmjs\.com|pkg\.go\.dev|libraries\.io|rubygems\.org|mvnrepository\.com|packagist\.org|nuget\.org)$")
NEED_NOUN = (r"(?i)(?<![^\W_])(?:librar(?:y|ies)|libs?|packages?|modules?|crates?|sdks?|frameworks?|toolkits?|clients?)"
             r"(?![^\W_])")
FREE_SOURCE_PRIORS = {"searxng": 0.75, "bing_news_rss": 0.6, "wikipedia": 0.6, "github": 0.5, "arxiv": 0.8,
                      "stack_exchange": 0.7}
DEFAULT_SOURCE_PRIOR = 0.5
PRIOR_WEIGHT = 4.0

# ---- platform feeds -------------------------------------------------------------------
SHOP_PLATFORM = r"""(?i)\bShopify\.shop\s*=|\bwindow\.ShopifyAnalytics\b|<meta[^>]+name=["']shopify-"""
SHOP_ASSETS = r"//cdn\.shopify\.com/s/files/|/cdn/shop/(?:files|products)/"
COLLECTION = r"(?i)^((?:/[a-z]{2}(?:-[a-z0-9]{2,4})?)?)/collections/([^/?#]+)/?$"

# Opening tags that end an open paragraph, and elements a paragraph's end is not looked for beyond.
ENDS_PARAGRAPH = frozenset(_w("""address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr main menu nav ol p pre section table ul"""))
HOLDS_PARAGRAPHS = frozenset(_w("article aside blockquote body button caption div figure footer form header li main nav object section table td th"))
# Other opening tags: the elements they end, and those they stay inside of.
IMPLIED_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
                "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
