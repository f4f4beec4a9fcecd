"""The labels, names and codes that the metrics test for or return.

Everything here is a value that data and results must share; nothing is computed.
"""

# Dates on which the source data starts to count.
AUDIT_FROM = "2018-01-01"
CORRESPONDENCE_FROM = "2017-12-01"
CONCERNED_FROM = "2018-10-01"
OPEN_CASES_FROM = "2018-10-01"
RESOLVED_CASES_FROM = "2018-10-01"
PERCENTILES_FROM = "2018-01-01"
ROUTING_FROM = "2018-01-01"
MARKS_FROM = "2018-10-01"
NEVER = "2099-01-01"

# Audit event types.
ROUTING = 1
SEVERITY_CHANGE = 20
CORRESPONDENCE = 179
REOPENING = 184
ROOT_CAUSE_MARK = 261
QUICKLINK = 370

# Audit descriptions.
GROUP_CHANGE = "Assigned Group"
PENDING_REASON = "Pending Reason"

# Root-cause marks, lower case.
TWO_DAY_MARKS = ["2day", "2days", "2 days"]
FIVE_DAY_MARKS = ["5day", "5days", "5 days"]
FOUR_A_MARKS = ["four eye check completed - document approved", "4a"]
FOUR_R_MARKS = ["four eye check completed - document rejected", "4r"]
FOUR_C_MARKS = ["four eye check required", "4c"]
FOUR_F_MARKS = ["4f"]
FOUR_NA_MARKS = ["4na"]
NOT_COUNTS = ["4f", "4r", "4a", "4c", "4na", "4ex"]

# System accounts and queues.
ESCALATION_ROBOT = "AR_ESCALATOR"
REOPENING_ROBOT = "flx-term"
HUB_ROBOT = "flx-HRDMIVS"
AUTOMATION_QUEUE = "DM-Automation-Queue"
TAO_ACCOUNT = "TAO Secondary"

# Characters dropped from the start of a quicklink.
QUICKLINK_PREFIX_CHARACTERS = "htps:/.amzoncquikl"

# Root causes of tickets that are no real cases.
TEST_ROOT_CAUSES = [
    "OAA/ALERT LIST WORKFLOW TICKET",
    "OAA/WORKFLOW TICKET",
    "Test - Do not include in metrics",
    "Test Ticket - Exclude from metrics",
    "Test Ticket - Remove from metrics",
    "Test Ticket - remove from metrics",
]

# Processes.
SHARED_PROCESS = "ALL"
BENEFITS = "Benefits"
EXITS = "Exits"
TRANSFERS = "Transfers"
ATTENDANCE = "Time and Attendance/CTK"

# SLA targets with a meaning of their own, and the target of a case without any.
NO_SLA = -1
TWO_STAGE_SLA = -5
DEFAULT_TARGET_DAYS = 2
FIRST_STAGE_HOURS = 48
SECOND_STAGE_HOURS = 120

# Resolver groups, as the country rule compares them: lower case.
CTI_COUNTRY_GROUPS = [
    "benefits cz corp - hr4hr",
    "benefits emea prg eng",
    "benefits emea prg hr4hr",
    "apac mnl ctk-jpn",
    "emea erc data management",
    "emea erc loa",
    "emea erc onboarding",
    "hrs recruiting support",
    "apac loa",
    "emea erc terminations",
    "hrs recruiting emea apac",
    "apac letter generation",
    "apac data management",
    "apac extended onboarding",
    "eu corp employee referrals",
    "apac terminations",
    "apac payroll prep",
    "apac benefits - hyd",
    "apac mnl hrs data mgmt green",
    "apac mnl hrs time attendance",
    "apac mnl hrs data management",
    "apac mnl hrs letter management",
    "apac mnl hrs immigration",
    "apac mnl hrs onboarding",
    "apac mnl hrs payroll prep",
    "apac mnl hrs benefit",
    "apac mnl hrs hr for hr",
    "apac mnl hrs leave of absence",
    "apac mnl hrs terminations",
]

# Categories that name a country.
CATEGORY_COUNTRIES = {
    "Human Resources - Belgium": "BEL",
    "Human Resources - Sweden": "SWE",
    "Human Resources - Norway": "NOR",
}
UNMAPPED = "Unmapped"
OTHER = "Other"

# Resolver groups with rules of their own.
EXTENDED_ONBOARDING = "ERC Extended Onboarding"
APAC_EXTENDED_ONBOARDING = "APAC Extended Onboarding"
ONBOARDING = "ERC Onboarding"
ONBOARDING_GROUPS = ["ERC Onboarding", "EMEA ERC Onboarding", "Internal Transfers"]
INDIA_ONBOARDING = "erc india onboarding"
AUDITED_GROUPS = ["Costa Rica ERC Data Management", "ERC Data Management", "ERC DM HR for HR"]
RECRUITING_GROUPS = ["Executive Recruiting", "Recruiting Sourcing Requests"]
UK_DATA_GROUP = "UK ERC Data Management"
TAO_GROUP = "TAO Team"
DUPLICATE_CLOSURE = "Duplicate"

# Items that count for the onboarding group.
ONBOARDING_ITEMS = [
    "Benefit Support Order",
    "Internal Transfer - International",
    "Merge Records (ERC Use Only)",
    "New Hire Paperwork",
    "Temp/Vendor/Contractor",
    "US - Corporate",
    "US - Customer Service",
    "US - NAFC 4+",
    "US - NAFC Tier 1 to Tier 3",
    "Bonus/Pay/Offer Letter Issue",
    "Conversion",
    "Direct Hires",
    "General Questions",
    "Badge Scan Failure",
    "BR-Corporate",
    "MEX - Corporate",
    "Corporate Offer Extension",
]

# The language-course case.
COURSE_CATEGORY = "EMEA HRS Learning"
COURSE_TYPE = "New enrollment"
COURSE_ITEM = "Instructor-led training"
COURSE_CAUSES = ["PRG Languages BN", "PRG Languages CZ"]
COURSE_TARGET_DAYS = 7

# Locations outside the one-day rule for impact 3.
NOT_ONE_DAY_SITES = ["IND", "HYD"]

# Benefit support orders: transaction type, items, hour limits, targets in days.
SUPPORT_ORDER = "Benefit Support Order"
WAITING_ITEM = "Waiting Period (90 Days)"
NOT_ENROLLED_ITEM = "Employee Not Enrolled"
SUPPORT_ORDER_ITEM = "Benefit Support Order"
SHORT_ORDER_HOURS = 480
LONG_ORDER_HOURS = 960
SHORT_ORDER_TARGET = 20
LONG_ORDER_TARGET = 40

# Resolutions: duplicates of a support order.
DUPLICATE_RESOLUTIONS = [
    '"Duplicate - 2nd Order/Non Compliance letter"',
    '"Duplicate - True Duplicate"',
    '"Other – General Query"',
    '"Others - Insurance Verification form"',
    '"Others - Not an NMSN/QMCSO "',
    '"Release - Duplicate"',
    "Duplicate - 2nd Order/Non Compliance letter",
    "Duplicate - Duplicate - 2nd Order/Non Compliance letter",
    "Duplicate - True Duplicate",
    "Others",
    "Others - General queries",
    "Others - general queries",
]

# Resolutions: duplicates as well where the target or the not-enrolled item is concerned.
FURTHER_DUPLICATE_RESOLUTIONS = [
    "Others - Insurance Verification form",
    "Other -Refund Requested",
]

# Resolutions: no SLA for a support order, by the list of the exists flag.
NO_TARGET_RESOLUTIONS = [
    '"Did not Enroll - Noncompliance - Original Order Missing"',
    '"Did not Enroll - Release received before processing NMSN"',
    '"Duplicate - 2nd Order/Non Compliance letter"',
    '"Duplicate - True Duplicate"',
    '"Other – General Query"',
    '"Others - Insurance Verification form"',
    '"Others - Not an NMSN/QMCSO "',
    '"Release - Dependents not enrolled"',
    '"Release - Duplicate"',
    '"Release - Employee Terminated"',
    '"Release - Employee not found"',
    "Duplicate - 2nd Order/Non Compliance letter",
    "Duplicate - Duplicate - 2nd Order/Non Compliance letter",
    "Duplicate - True Duplicate",
    "Others",
    "Release - Employee Terminated",
    "Release - Employee not found",
]

# Resolutions: enrolled.
ENROLLED_RESOLUTIONS = [
    '"Enrolled -Enrolled Dependent"',
    "Enrolled -Enrolled Dependent",
    "Enrolled Dependent",
    '"Enrolled Dependent"',
]
ENROLLED_WITH_TARGET = ['"Enrolled -Enrolled Dependent"', "Enrolled -Enrolled Dependent"]

# Resolutions: a support order that ended without enrolment.
NO_ENROLMENT_RESOLUTIONS = [
    '"Did not Enroll - Employee Terminated"',
    '"Did not Enroll - Employee has other garnishment"',
    '"Did not Enroll - Employee not eligible"',
    '"Did not Enroll - Employee not found"',
    '"Did not Enroll - Group ID not eligible"',
    '"Did not Enroll - Missing Information in Court Order"',
    '"Did not enroll - Not eligible"',
    '"Did not enroll-Employee Terminated"',
    '"Release - Dropped QMSCO Flags in WTW"',
    '"Release – Refund Request"',
    "Did not Enroll - Employee Terminated",
    "Did not Enroll - Employee has other garnishment",
    "Did not Enroll - Employee not found",
    "Did not Enroll - Employee on LOA",
    "Did not Enroll - Group ID not eligible",
    '"Did not Enroll - Employee has other garnishments"',
    "Did not Enroll - Employee has other garnishments",
    "Release - QMCSO flags dropped in WTW",
    '"Did not Enroll - Release received before processing NMSN"',
    '"Did not Enroll - Noncompliance - Original Order Missing"',
    "Did not Enroll - Noncompliance - Original Order Missing",
    '"Release - Dependents not enrolled"',
    '"Release - Employee not found"',
    '"Release - Employee Terminated"',
    "Release - Employee Terminated",
    "Release - Employee not found",
    "Did not Enroll - Release received before processing NMSN",
    '"Release - QMCSO flags dropped in WTW"',
]

# Defect labels.
NOT_DEFECT_SCOPE = "Not Defect Scope"
BLANK = "Blank"
OTHER_ROOT_CAUSE = "Other root cause"
NO_DEFECT = "No Defect"
HRS_DEFECT = "HRS Defect"
LIFECYCLE_DEFECT = "Lifecycle Defect"
MISSING_INFO = "Missing Info"
PROCESS_DEPENDENCY = "Process Dependency"
ROUTED_LATE = "Routed_After_SLA_Lapse"
REOPENED_BY_SYSTEM_LATE = "Reopened_Sys_After_SLA_Lapse"
REOPENED_BY_PERSON_LATE = "Reopened_Pers_After_SLA_Lapse"

# Words in the details of a root cause.
MISSING_INFO_WORDS = ["escalation protocol", "other", "pending", "waiting", "follow", "update"]
PROCESS_WORDS = ["future", "ldw", "process", "last day of work", "stop", "work"]

# Delivery sites and hubs.
MANILA_HUBS = "Manila Hubs"
MANILA_COUNTRY_SITES = {"PHL": "MNL", "CHN": "CHN", "JPN": "JPN"}
SHARED_SITES = ["IND/CRI", "CRI/IND"]
COSTA_RICA_SITE = "CRI"
INDIA_SITE = "IND"
SEATTLE_SITE = "SEA"
COSTA_RICA_HUB = "Costa Rica Hub"
INDIA_HUBS = "India Hubs"
COSTA_RICA_TRANSACTION = "Benefits Administration"

# Process and line-of-business labels.
EXTENDED_ONBOARDING_PROCESS = "EOB"
EMEA = "EMEA"
EXTENDED_ONBOARDING_ITEM = "Extended Onboarding"
SERVICE_LINE = "CS"
CORPORATE_LINE = "CORP"
OPERATIONS_LINE = "OPS"
CONSUMER_LINE = "WW_CONSUMER"
OPERATIONS_DEPARTMENT = "Ops & Cust Svc"
