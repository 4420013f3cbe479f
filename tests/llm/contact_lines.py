"""Lines written by hand, with the spans of personal data and secrets in them, and lines without any."""

LINES = [
    ("You can always write to john at gmail dot com if something breaks.", [("email", "john at gmail dot com")]),
    ("Questions go to maria.lopez [at] unihospital [dot] es before Friday.", [("email", "maria.lopez [at] unihospital [dot] es")]),
    ("Bitte melden bei thomas (at) stadtwerke (dot) de oder persönlich.", [("email", "thomas (at) stadtwerke (dot) de")]),
    ("The author, kwong[at]biolab.org, declined to comment.", [("email", "kwong[at]biolab.org")]),
    ("Reach our treasurer under finance dot team at riverside dot co dot uk anytime.", [("email", "finance dot team at riverside dot co dot uk")]),
    ("Ping r.patel(at)fastmail(dot)com about the keys.", [("email", "r.patel(at)fastmail(dot)com")]),
    ("Correo: lucia arroba correo punto es, respondo por la tarde.", [("email", "lucia arroba correo punto es")]),
    ("Call 555.123.4567 after six and ask for Dana.", [("phone", "555.123.4567")]),
    ("If nobody opens, ring 0171 5550123 and wait.", [("phone", "0171 5550123")]),
    ("Our office (415) 555-2671 is closed on Sunday.", [("phone", "(415) 555-2671")]),
    ("Mon portable est le 06 12 34 56 78, merci.", [("phone", "06 12 34 56 78")]),
    ("Telefonisch erreichbar unter 030/90182736 bis 17 Uhr.", [("phone", "030/90182736")]),
    ("Para reservas llame al 915 123 456 de lunes a viernes.", [("phone", "915 123 456")]),
    ("Text 646-555-0199 to get the address of the venue.", [("phone", "646-555-0199")]),
    ("Handy: 0160 95554321. Bitte nur abends.", [("phone", "0160 95554321")]),
    ("The clinic gave me two numbers, 212 555 7788 and a fax.", [("phone", "212 555 7788")]),
    ("Toll free 1-800-555-0142 for orders abroad.", [("phone", "1-800-555-0142")]),
    ("Her social security number is 078-05-1120 and should not be printed.", [("id", "078-05-1120")]),
    ("Mi DNI 12345678Z caduca en mayo.", [("id", "12345678Z")]),
    ("Please transfer it to IBAN DE89 3704 0044 0532 0130 00 by Monday.", [("id", "DE89 3704 0044 0532 0130 00")]),
    ("Passnummer: C01X00T47, ausgestellt in Köln.", [("id", "C01X00T47")]),
    ("The passport no. X4728193 was reported stolen.", [("id", "X4728193")]),
    ("National insurance number QQ 12 34 56 C appears on the letter.", [("id", "QQ 12 34 56 C")]),
    ("Steuernummer 21/815/08150 bitte immer angeben.", [("id", "21/815/08150")]),
    ("SSN: 219-09-9999 (verified).", [("id", "219-09-9999")]),
    ("Numéro de sécurité sociale : 1 85 05 78 006 084 36 reçu hier.", [("id", "1 85 05 78 006 084 36")]),
    ("driver's license number D1234567 was on the form", [("id", "D1234567")]),
    ("medical record number 00482913 belongs to another patient", [("id", "00482913")]),
    ('export API_KEY="f3b1c9d27a6e4c0b9d8f7e6a5b4c3d2e" before running the job', [("secret", "f3b1c9d27a6e4c0b9d8f7e6a5b4c3d2e")]),
    ("the password is Tr0ub4dor&3 and please change it", [("secret", "Tr0ub4dor&3")]),
    ("aws_secret_access_key = wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY7", [("secret", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY7")]),
    ("auth token: ghp_16C7e42F292c6912E7710c838347Ae178B4a for the build", [("secret", "ghp_16C7e42F292c6912E7710c838347Ae178B4a")]),
    ('client_secret: "9c2f7a41-77be-4c0d-a1b2-3c4d5e6f7a8b"', [("secret", "9c2f7a41-77be-4c0d-a1b2-3c4d5e6f7a8b")]),
    ("Passwort: Sommer2019! gilt bis Ende des Monats", [("secret", "Sommer2019!")]),
]

CLEAN = [
    "The council met in 1998 and again in 2004 to discuss the bridge.",
    "Turn left at the church, then walk 250 metres to the river.",
    "Version 3.11.4 was released on 2023-06-06 with 57 fixes.",
    "She paid $1,299.00 for the 15.6 inch model at the airport.",
    "Chapter 12, page 348, describes the siege of 1529.",
    "The population grew from 12,400 to 18 750 within ten years.",
    "A dot at the end of the line is a full stop.",
    "The train leaves at 07:45 and arrives at 11:20 on platform 9.",
    "Scores of 3-1, 2-2 and 0-4 put the club at the bottom.",
    "Use 200 g of flour, 2 eggs and 125 ml of milk.",
    "Passport control was slow, with 400 people in the queue.",
    "A password should have at least 12 characters.",
    "The token economy of the game was changed in 2016.",
    "Der Zug fährt um 8:30 Uhr ab und kostet 29,90 Euro.",
    "Le musée a reçu 1 200 000 visiteurs en 2019.",
    "La temperatura subió a 38 grados el 12 de julio de 2022.",
    "See section 4.2.1 and table 7 for the 95% intervals.",
    "The resolution is 1920 x 1080 at 60 Hz.",
    "ISBN 978-3-16-148410-0 is a made-up example.",
    "Room 204 is on the second floor, next to 206.",
]
