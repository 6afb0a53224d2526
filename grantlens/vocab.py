"""Word lists, tables and weights."""

# Results must agree on them.
TARGETS = [
    "Samaritan's Purse", "Campus Crusade for Christ", "World Vision", "Billy Graham Evangelistic Association", "Hope International",
    "International Justice Mission", "Doctors without Borders", "Plant with Purpose", "World Relief", "Compassion International", "CRU",
    "SIM International", "Frontiers", "Lifewater International", "Voice of the Martyrs", "International Fellowship of Christian and Jews",
    "Operation Blessing International", "Church World Service", "Hope Walks", "YWAM", "Youth with a Mission", "Young Life", "Feed the Children",
    "Salvation Army", "Tearfund", "MAP International", "Convoy of Hope", "Living Water International", "Christian Aid Mission", "WorldVentures",
    "Heifer International", "CURE", "Wycliffe Bible Translators", "SIL International", "Trans World Radio", "OM", "Operation Mobilization",
    "Global Disciples", "Christ for All Nations", "Pioneers", "Jesus Film Project", "Biblica", "GO Movement", "Faith Comes by Hearing",
    "Luis Palau Association", "Alpha International", "Joshua Project", "Ethnos360", "Every Home for Christ", "Open Doors",
    "Christian Solidarity International", "Release International", "Navigators", "InterVarsity Christian Fellowship",
    "Fellowship of Christian Athletes", "Prison Fellowship", "American Bible Society", "Gideons International", "Awana",
    "Child Evangelism Fellowship", "Focus on the Family", "OMF International", "Send Relief", "World Gospel Mission", "Joshua Fund",
    "Medical Ambassadors International",
]
ALIASES = {
    "campus crusade for christ": "CRU", "campus crusade": "CRU", "cru international": "CRU", "world vision international": "World Vision",
    "world vision inc": "World Vision", "samaritans purse": "Samaritan's Purse", "samaritan purse": "Samaritan's Purse",
    "franklin graham": "Samaritan's Purse", "billy graham evangelistic assn": "Billy Graham Evangelistic Association",
    "bgea": "Billy Graham Evangelistic Association", "ijm": "International Justice Mission", "msf": "Doctors without Borders",
    "medecins sans frontieres": "Doctors without Borders", "doctors without borders usa": "Doctors without Borders",
    "ywam": "Youth with a Mission", "youth with a mission": "YWAM", "wycliff bible translators": "Wycliffe Bible Translators",
    "wycliffe": "Wycliffe Bible Translators", "operation mobilization": "OM", "operation mobilisation": "OM", "om international": "OM",
    "compassion intl": "Compassion International", "heifer intl": "Heifer International", "heifer project": "Heifer International",
    "salvation army": "Salvation Army", "the salvation army": "Salvation Army", "young life inc": "Young Life",
    "feed the children inc": "Feed the Children", "map intl": "MAP International", "sim usa": "SIM International", "sim": "SIM International",
    "sil": "SIL International", "trans world radio inc": "Trans World Radio", "twr": "Trans World Radio",
    "voice of the martyrs": "Voice of the Martyrs", "vom": "Voice of the Martyrs", "ethos360": "Ethnos360", "new tribes mission": "Ethnos360",
    "fca": "Fellowship of Christian Athletes", "intervarsity": "InterVarsity Christian Fellowship", "the navigators": "Navigators",
    "gideons": "Gideons International", "omf": "OMF International", "the joshua fund": "Joshua Fund",
}
CLUSTERS = {
    "religious_identity": ["Christian", "Christianity", "Catholic", "Episcopal", "Methodist", "Baptist", "Presbyterian", "Christ", "Church", "Faith", "Faith Based", "Bible", "Scripture", "Gospel", "Missionary"],
    "mission_outreach": ["Ministry", "Ministries", "Mission", "Missions", "Evangelism", "Disciple", "Discipleship", "Hope", "Relief", "Refugee", "Humanitarian", "Orphan", "Unreached", "Indigenous", "Cross-cultural"],
    "geography": ["Africa", "South America", "Latin America", "Middle East", "Israel", "Asia", "Global"],
    "denominations": ["Lutheran", "Pentecostal", "Anglican", "Evangelical", "Reformed", "Wesleyan", "Mennonite", "Nazarene", "Adventist", "Assemblies of God", "Charismatic", "Orthodox", "Quaker", "Moravian", "Brethren", "Vineyard"],
    "theology": ["Jesus", "Lord", "Kingdom", "Redeemer", "Savior", "Salvation", "Worship", "Prayer", "Chaplain", "Seminary", "Theological", "Diocese", "Parish", "Congregation", "Pastor", "Clergy", "Apostolic", "Holy Spirit", "Sacred"],
}
COMPOUNDS = ["Faith Based", "Latin America", "South America", "Middle East", "Cross-cultural", "Assemblies of God", "Holy Spirit"]
STOP_WORDS = ["foundation", "inc", "incorporated", "corp", "corporation", "trust", "fund", "charitable", "philanthropy", "philanthropic", "organization", "org", "association", "assoc", "llc", "ltd", "the", "a", "an", "of", "for", "and", "&", "fdn", "fdtn"]
ABBREVIATIONS = {"fam": "family", "tr": "trust", "char": "charitable", "fdtn": "foundation", "fdn": "foundation", "intl": "international", "natl": "national", "ctr": "center", "svcs": "services", "mgmt": "management", "dev": "development", "educ": "education", "comm": "community", "assn": "association"}
FORMER_NAMES = ["fka", "formerly known as", "formerly", "f/k/a", "dba", "d/b/a", "doing business as", "aka", "a/k/a", "also known as"]
FAITH_TAGS = ["Christian Ministry", "Church", "Bible Translation", "Evangelism", "Church Planting", "Pregnancy Center", "Christian School", "International Missions", "Jewish Ministry", "Faith-Based Education", "Rescue Mission", "Youth Ministry", "Medical Missions"]
SECULAR_TAGS = ["Disaster Relief", "Human Trafficking", "Homelessness", "Food Security", "Agriculture", "Medical", "Education", "Arts", "Human Services", "Community Development", "Child Sponsorship", "Poverty", "Israel", "Humanitarian Aid", "Prison Ministry"]
COMPONENTS = [
    (40.0, FAITH_TAGS), (15.0, ["Church", "Church Planting"]), (15.0, ["International Missions", "Medical Missions", "Bible Translation"]),
    (10.0, ["Evangelism", "Church Planting"]), (10.0, ["Christian School", "Faith-Based Education"]),
]
CONSISTENCY = 10.0
TIERS = [(95, "Dedicated Christian Funder"), (80, "Strong Faith-Based Funder"), (60, "Regular Faith-Based Giving"), (40, "Occasional Faith-Based Giving"), (0, "No Significant Faith-Based Pattern")]
STARS = [(80, "★★★★★"), (60, "★★★★"), (40, "★★★"), (15, "★★"), (0, "★")]
RULES = [
    (r"\bchurch(es)?\b", ["Church"]),
    (r"\b(parish|cathedral|chapel|archdiocese|diocese)\b", ["Church"]),
    (r"\bministr(y|ies)\b", ["Christian Ministry"]),
    (r"\b(baptist|lutheran|methodist|presbyterian|pentecostal|wesleyan|nazarene|mennonite|episcopal|anglican|catholic)\b", ["Christian Ministry"]),
    (r"\bbible translat", ["Bible Translation"]),
    (r"\bbible\b", ["Christian Ministry"]),
    (r"\b(seminary|theological)\b", ["Faith-Based Education"]),
    (r"\bchristian (school|academy|college|university|education)\b", ["Christian School"]),
    (r"\brescue mission\b", ["Rescue Mission"]),
    (r"\bmissionar(y|ies)\b", ["International Missions"]),
    (r"\bgospel\b", ["Evangelism"]),
    (r"\bevangeli", ["Evangelism"]),
    (r"\bchurch plant", ["Church Planting"]),
    (r"\bpregnancy (care |resource )?(center|clinic)\b", ["Pregnancy Center"]),
    (r"\b(youth for christ|young life|awana|campus crusade)\b", ["Youth Ministry"]),
    (r"\b(synagogue|chabad|yeshiva|torah|hillel)\b", ["Jewish Ministry"]),
    (r"\bsalvation army\b", ["Christian Ministry", "Homelessness", "Disaster Relief"]),
    (r"\bchristian\b", ["Christian Ministry"]),
]
CONFIDENCE_MIN, CLASSIFY_MIN_GRANT, CLASSIFY_BATCH = 70, 5000, 20
SEEDS = {
    "Samaritan's Purse": ["Christian Ministry", "Disaster Relief", "International Missions"],
    "Billy Graham Evangelistic Association": ["Evangelism", "Christian Ministry"],
    "Wycliffe Bible Translators": ["Bible Translation", "International Missions"],
    "SIL International": ["Bible Translation", "International Missions"],
    "Fellowship of Christian Athletes": ["Youth Ministry", "Evangelism"],
    "Compassion International": ["Child Sponsorship", "Christian Ministry", "Poverty"],
    "World Vision": ["Christian Ministry", "Disaster Relief", "International Missions"],
    "Catholic Charities": ["Christian Ministry", "Human Services"],
    "Young Life": ["Youth Ministry"],
    "Prison Fellowship": ["Evangelism", "Prison Ministry"],
    "Salvation Army": ["Christian Ministry", "Homelessness", "Disaster Relief"],
    "CRU": ["Evangelism", "Youth Ministry"],
    "OM": ["International Missions"],
    "Send Relief": ["Disaster Relief", "International Missions"],
    "YWAM": ["International Missions", "Evangelism"],
    "Youth with a Mission": ["International Missions", "Evangelism"],
    "World Gospel Mission": ["International Missions"],
    "Joshua Fund": ["Israel", "Christian Ministry", "Humanitarian Aid"],
    "Medical Ambassadors International": ["Medical Missions", "Community Development", "Christian Ministry"],
    "Equipping Farmers International": ["Agriculture", "Christian Ministry", "International Missions"],
    "Christian Aid Mission": ["International Missions", "Church Planting"],
    "WorldVentures": ["International Missions", "Church Planting"],
    "Hope International": ["Christian Ministry", "Poverty"],
    "International Justice Mission": ["Christian Ministry", "Human Trafficking"],
    "Doctors without Borders": ["Medical", "Humanitarian Aid"],
    "Plant with Purpose": ["Christian Ministry", "Agriculture"],
    "World Relief": ["Christian Ministry", "Disaster Relief"],
    "SIM International": ["International Missions"],
    "Frontiers": ["International Missions"],
    "Lifewater International": ["Christian Ministry", "Community Development"],
    "Voice of the Martyrs": ["Christian Ministry", "International Missions"],
    "International Fellowship of Christian and Jews": ["Jewish Ministry", "Israel"],
    "Operation Blessing International": ["Christian Ministry", "Disaster Relief"],
    "Church World Service": ["Christian Ministry", "Disaster Relief"],
    "Hope Walks": ["Medical Missions", "Christian Ministry"],
    "Feed the Children": ["Food Security", "Poverty"],
    "Tearfund": ["Christian Ministry", "Disaster Relief"],
    "MAP International": ["Medical Missions", "Christian Ministry"],
    "Convoy of Hope": ["Christian Ministry", "Disaster Relief", "Food Security"],
    "Living Water International": ["Christian Ministry", "Community Development"],
    "Heifer International": ["Agriculture", "Poverty"],
    "CURE": ["Medical Missions", "Christian Ministry"],
    "Trans World Radio": ["Evangelism", "International Missions"],
    "Global Disciples": ["Evangelism", "Church Planting"],
    "Christ for All Nations": ["Evangelism"],
    "Pioneers": ["International Missions", "Church Planting"],
    "Jesus Film Project": ["Evangelism", "International Missions"],
    "Biblica": ["Bible Translation", "Christian Ministry"],
    "GO Movement": ["Evangelism"],
    "Faith Comes by Hearing": ["Bible Translation", "Evangelism"],
    "Luis Palau Association": ["Evangelism"],
    "Alpha International": ["Evangelism", "Christian Ministry"],
    "Joshua Project": ["International Missions"],
    "Ethnos360": ["International Missions", "Church Planting", "Bible Translation"],
    "Every Home for Christ": ["Evangelism"],
    "Open Doors": ["Christian Ministry", "International Missions"],
    "Christian Solidarity International": ["Christian Ministry", "Human Trafficking"],
    "Release International": ["Christian Ministry", "International Missions"],
    "Navigators": ["Evangelism", "Christian Ministry"],
    "InterVarsity Christian Fellowship": ["Youth Ministry", "Evangelism"],
    "American Bible Society": ["Bible Translation", "Christian Ministry"],
    "Gideons International": ["Evangelism", "Christian Ministry"],
    "Awana": ["Youth Ministry", "Evangelism"],
    "Child Evangelism Fellowship": ["Youth Ministry", "Evangelism"],
    "Focus on the Family": ["Christian Ministry"],
    "OMF International": ["International Missions"],
    "Campus Crusade for Christ": ["Evangelism", "Youth Ministry"],
    "Billy Graham": ["Evangelism", "Christian Ministry"],
}
FAITH_TERMS = ["religion", "religious", "faith", "christian", "church", "ministry", "gospel", "bible", "missionary"]
ABROAD_TERMS = ["international", "global", "foreign", "overseas", "developing countries", "humanitarian"]
FIELD_WEIGHTS = {"activities": 3, "purposes": 2, "name": 1}
SHORT_WORDS = ["inc", "llc", "ltd", "co", "jr", "sr", "ii", "iii", "iv", "us", "ny", "ca", "tx", "fl", "pa", "oh", "il"]
NO_WEBSITE = ["N/A", "NA", "NONE", "NOT APPLICABLE", "N.A."]
GRANT_SIZES = [(100000, 40), (50000, 33), (25000, 26), (10000, 20), (5000, 13), (1000, 7)]
# End of fixed values.
