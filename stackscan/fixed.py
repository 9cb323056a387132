"""Fixed values.

Word lists, lookup tables and limits whose exact content decides the results. They are
plain data: each is stated in full, in its natural order.
"""

# Category id -> category name.
CATEGORY_NAMES = {
    1: "CMS",
    2: "Message Boards",
    3: "Message Boards",
    4: "Wiki",
    5: "LMS",
    6: "Web Server",
    7: "CDN",
    8: "Programming Language",
    9: "JavaScript Framework",
    10: "Analytics",
    11: "Advertising",
    12: "JavaScript Framework",
    14: "Video Platform",
    15: "Image Processing",
    16: "Database",
    17: "JavaScript Framework",
    18: "Web Server",
    19: "Operating System",
    20: "Web Server",
    21: "Web Server",
    22: "Web Server",
    23: "Web Server",
    24: "Web Server",
    25: "JavaScript Framework",
    26: "JavaScript Framework",
    27: "JavaScript Framework",
    28: "JavaScript Framework",
    29: "JavaScript Framework",
    30: "JavaScript Framework",
    31: "JavaScript Framework",
    32: "JavaScript Framework",
    33: "JavaScript Framework",
    34: "JavaScript Framework",
    35: "JavaScript Framework",
    36: "Advertising",
    37: "Advertising",
    38: "Advertising",
    39: "Advertising",
    40: "Advertising",
    41: "Advertising",
    42: "Advertising",
    43: "Advertising",
    44: "Advertising",
    45: "Advertising",
    46: "Advertising",
    47: "Advertising",
    48: "Advertising",
    49: "Advertising",
    50: "Advertising",
    51: "Advertising",
    52: "Chatbot",
    53: "SIS",
    54: "CRM",
    55: "CRM",
    56: "CRM",
    57: "CMS",
    58: "CMS",
    59: "JavaScript Framework",
    60: "JavaScript Framework",
    61: "JavaScript Framework",
    62: "JavaScript Framework",
    63: "JavaScript Framework",
    64: "JavaScript Framework",
    65: "JavaScript Framework",
    66: "JavaScript Framework",
    67: "JavaScript Framework",
    68: "JavaScript Framework",
    69: "JavaScript Framework",
    70: "JavaScript Framework",
    71: "Booking System",
    72: "Booking System",
    73: "Booking System",
    74: "Booking System",
    75: "Booking System",
    76: "Booking System",
    77: "Advertising",
    78: "Advertising",
    79: "Advertising",
    80: "CMS",
    81: "CMS",
    82: "CMS",
    83: "CMS",
    84: "CMS",
    85: "CMS",
    86: "CMS",
    87: "CMS",
    88: "CMS",
    89: "CMS",
    90: "CMS",
    91: "CMS",
    92: "CMS",
    93: "CMS",
    94: "CMS",
    95: "CMS",
    96: "CMS",
    97: "CMS",
    98: "CMS",
    99: "CMS",
    100: "CMS",
    101: "CMS",
    102: "CMS",
    103: "CMS",
    104: "CMS",
    105: "CMS",
    106: "CMS",
    107: "Payment Processor",
    108: "Payment Processor",
    109: "Payment Processor",
    110: "Payment Processor",
    111: "Accessibility",
}

# Path or link-text fragments of pages worth scanning.
STRATEGIC_PATHS = (
    "/login", "/portal", "/student", "/faculty", "/courses", "/library", "/learn", "/lms",
    "/sis", "/blackboard", "/canvas", "/continuing-education", "/continuing_education",
    "/professional-development", "/workforce", "/catalog", "/ce/", "/extension",
)

# Fallback words when a page has no strategic link.
FALLBACK_WORDS = (
    "student", "faculty", "portal", "login", "course", "learn", "library",
)

# Path fragments that drop a page from a scan.
EXCLUDED_PATHS = (
    "/admin", "/login", "/portal", "/secure", "/private", "/auth", "/wp-admin",
    "/administrator",
)

# Subdomain / path prefixes derived from a site's host.
DERIVED_PREFIXES = (
    "catalog", "events", "giving", "apply", "library", "search",
)

# Paths probed on every origin.
PROBE_PATHS = (
    "/wp-login.php", "/wp-json/wp/v2/", "/wp-content/", "/user/login", "/core/install.php",
    "/cas/login", "/Shibboleth.sso/Metadata",
)

# JavaScript globals whose presence is recorded as evidence.
JS_GLOBALS = (
    "Banner", "BWCK", "Colleague", "DatatelUI", "PeopleSoft", "PS", "Jenzabar", "JICS",
    "PowerCampus", "Blackboard", "bbNG", "page.bbNG", "D2L", "d2l", "sakai", "Sakai",
    "OmniCMS", "omni", "TerminalFour", "T4", "ModernCampus", "Shibboleth", "CAS",
    "Navigate", "EAB", "Starfish", "kaltura", "kWidget", "Panopto", "ExLibris", "Alma",
    "Primo", "TouchNet", "uPay", "Transact", "BBTransact", "CBORD", "TwentyFiveLive", "EMS",
    "Localist", "webpackChunkcanvas_lms", "M.core", "Y.Moodle",
)

# Words too common to stand alone as a ledger pattern.
TIER_COMMON_WORDS = (
    "banner", "navigate", "colleague", "cascade", "starfish", "canvas", "moodle", "sakai",
    "alma", "primo", "parchment", "compass", "populi", "ultra", "modern", "campus",
    "student", "portal", "login", "home", "slate", "revel", "summon", "focus", "encoura",
    "element", "absorb",
)

# Words the audit rejects as a standalone pattern.
AUDIT_COMMON_WORDS = (
    "banner", "navigate", "colleague", "cascade", "starfish", "canvas", "react", "angular",
    "ultra", "modern", "campus", "student", "portal", "login", "home", "page", "site",
    "web", "app", "system", "platform", "service", "server", "client", "user", "data",
    "info", "content", "form", "button", "link", "menu", "header", "footer", "main", "body",
    "class", "style", "script", "image", "text", "title", "name", "type", "value", "event",
    "action", "function", "object", "array", "string", "number", "boolean", "null",
    "undefined", "true", "false", "success", "error", "message", "alert", "warning",
    "notification", "status", "bootstrap", "jquery", "vue", "moodle", "sakai", "alma",
    "primo",
)

# JavaScript global names the audit rejects.
AUDIT_SHORT_GLOBALS = (
    "s", "ga", "$", "_", "a", "b", "c", "d", "e", "i", "j", "k", "n", "o", "p", "q", "r",
    "t", "u", "v", "w", "x", "y", "z", "PS", "bb", "d2l", "cas", "ems",
)

# Name fragments that raise or lower research priority.
HIGH_PRIORITY_HINTS = (
    "Anthology", "Modern Campus", "Slate", "Element451", "EAB", "Watermark", "Campus Labs",
    "CBORD", "Academic Works", "Mindmax", "HelioCampus", "Civitas", "CampusLogic",
    "AwardSpring", "Regent", "Brightspace", "Instructure Canvas Catalog", "Alma", "Primo",
    "Colleague", "Jenzabar", "Populi", "Veracross", "Rediker", "CampusVue",
    "Campus Management Suite", "PowerCampus", "Tribal",
)
LOW_PRIORITY_HINTS = (
    "Canvas LMS", "Blackboard Learn", "Moodle", "Drupal", "Google Workspace",
    "Google Classroom", "Microsoft Teams", "Ellucian Banner", "Workday Student", "YouTube",
    "Vimeo", "Adobe", "Okta", "Salesforce",
)

# Description keywords of student information systems.
SIS_KEYWORDS = (
    "student", "banner", "colleague", "peoplesoft", "workday", "jenzabar", "powercampus",
    "anthology", "campus", "populi", "infinite", "sis", "campusvue", "campuslogic",
    "regent", "smart catalog", "skyward", "focus", "veracross", "renweb", "facts",
    "gradelink", "quickschools", "sits", "sims", "tribal", "synergy", "schooladmin",
    "rediker", "powerschool",
)

# Systems expected in each market segment.
MARKET_SEGMENTS = {
    "Legacy Leaders": (
        "Ellucian Banner", "Ellucian Colleague", "CampusVue",
    ),
    "Enterprise Cloud": (
        "Workday Student", "PeopleSoft Campus Solutions", "PowerSchool SIS",
    ),
    "Mid-Market": (
        "Jenzabar", "PowerCampus", "Anthology Student", "Unit4 Student Management",
    ),
    "Specialized/Niche": (
        "Populi", "Infinite Campus", "CampusLogic", "Smart Catalog", "Regent Education",
    ),
    "Independent Schools": (
        "Veracross", "RenWeb", "FACTS SIS", "Gradelink", "QuickSchools", "SchoolAdmin",
    ),
    "K-12 Extending": (
        "Skyward Student Management", "Focus School Software",
        "Synergy Student Information System", "Rediker Software",
    ),
    "International": (
        "SITS", "SIMS", "Tribal Student Management", "Campus Management Suite", "StudIS",
    ),
}

# Systems a complete higher-education library covers.
EXPECTED_SYSTEMS = (
    "Ellucian Banner", "Ellucian Colleague", "Oracle PeopleSoft Campus Solutions",
    "Blackboard Learn", "D2L Brightspace", "Canvas LMS", "Moodle", "Modern Campus CMS",
    "TerminalFour", "Shibboleth", "CAS", "Kaltura", "Panopto", "Slate", "TouchNet",
    "Workday Student", "Anthology Student", "Duo Security", "Turnitin", "25Live",
)

# Content management systems listed as popular after an import.
POPULAR_CMS = (
    "WordPress", "Drupal", "Joomla", "Sitecore", "Adobe Experience Manager", "Wix",
    "Squarespace", "Ghost", "TYPO3", "Umbraco", "Kentico",
)
