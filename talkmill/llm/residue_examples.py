"""Labelled messages for the classifier of `residue`: wording of its own in seven languages, not taken from any table.

RESIDUE are messages that stand in place of content; ORDINARY are content, among it such as reports or quotes residue. Messages
are given as written; slots, numbers, addresses and dates are masked as in any text.
"""

RESIDUE = {
    "scripts": """Please turn on JavaScript and reload
JavaScript must be enabled to use this portal
This application requires JavaScript
Scripts are blocked in your browser, allow them to continue
We are sorry but this page does not work without JavaScript enabled
Cookies and JavaScript have to be switched on
noscript
Content needs scripts and cannot be shown
You have JavaScript turned off
The map cannot load because scripts are disabled
Your browser does not support scripts
Unsupported browser, please upgrade
Enable cookies and scripts, then refresh
Update your browser to see this content
Sie müssen JavaScript aktivieren, um fortzufahren
JavaScript ist in Ihrem Browser deaktiviert
Diese Seite benötigt JavaScript
Habilite JavaScript en su navegador
Esta página requiere JavaScript
Su navegador tiene los scripts desactivados
Habilite o JavaScript para ver os imóveis
Este site precisa de JavaScript ativado
कृपया जावास्क्रिप्ट चालू करें
यह पृष्ठ देखने के लिए जावास्क्रिप्ट सक्षम करें
जावास्क्रिप्ट सुरू करा
దయచేసి జావాస్క్రిప్ట్ ప్రారంభించండి""",
    "errors": """404 not found
HTTP 500 internal server error
403 Forbidden
Error 502 bad gateway
HTTP error 503
Service unavailable
Page not found
The requested URL was not found on this server
The page you are looking for has moved or no longer exists
This listing is no longer available
The link has expired or was removed
Oops, something broke on our end
Sorry, something failed on our side
We ran into an error, we are working on it
An unexpected error occurred, please try later
Please try again later
Reload the page or come back after some time
Go back to the home page
Return to homepage
Your session timed out, log in again
Sign in to continue
You are not authorised to open this page
Access to this resource is denied
Permission denied
Request blocked because of suspicious activity
Prove you are human to proceed
Complete the captcha to continue
Rate limit exceeded, wait before sending another request
The server is down for maintenance
This site is under maintenance
The connection timed out
Database connection failed
Could not reach the upstream server
Gateway time-out
Request ID: 77120
Traceback (most recent call last)
File "views.py", line 88, in get
ValueError: invalid literal
TypeError: cannot read properties of undefined
Uncaught exception in thread main
KeyError: 'amount'
IndexError: list index out of range
RuntimeError: worker stopped
File "app/main.py", line 12, in load
java.lang.NullPointerException at Loader.run
Fatal error: out of memory in worker 3
panic: connection refused
Stack trace follows
Fehler 404
Seite wurde nicht gefunden
Ein unerwarteter Fehler ist aufgetreten
Der Dienst ist vorübergehend nicht verfügbar
Bitte laden Sie die Seite neu
Ihre Sitzung ist abgelaufen
Zugriff verweigert
Error del servidor
La página solicitada no existe
Este anuncio ya no está publicado
Vuelva a intentarlo más tarde
Su sesión ha caducado
Acceso denegado
Serviço indisponível no momento
A página que você procura não existe
Este anúncio foi removido
Tente novamente mais tarde
Erro no servidor
Sua sessão expirou
Acesso negado
पेज उपलब्ध नहीं है
यह पृष्ठ मौजूद नहीं है
सर्वर में त्रुटि
कृपया बाद में पुनः प्रयास करें
मुख्य पृष्ठ पर जाएँ
पान सापडले नाही
सर्वर त्रुटी
पेजी కనుగొనబడలేదు
సర్వర్ లోపం
తర్వాత మళ్లీ ప్రయత్నించండి
We could not find that page
This property has been taken off the site
Sorry, we can't seem to find what you are looking for: page not found
Your connection was refused by the server
500 Internal Server Error
Our servers are overloaded at the moment
Please refresh your browser
Authentication required, please log in
Your login has expired
Turn JavaScript on to load the gallery
To use this site, enable JavaScript first
JavaScript seems to be disabled in your browser
Please allow scripts for this website
nginx 504 gateway time-out
Unhandled exception in request handler
AttributeError: 'NoneType' object has no attribute 'price'
SyntaxError: unexpected token in JSON
Die angeforderte Seite existiert nicht: Fehler 404
Bitte aktivieren Sie Skripte und JavaScript in Ihrem Browser
Este sitio necesita JavaScript para funcionar
Página no disponible, inténtelo más tarde
Para continuar, ative o JavaScript
Página não encontrada
इस साइट के लिए जावास्क्रिप्ट ज़रूरी है, चालू करें
पृष्ठ नहीं मिला
పేజీ కనుగొనబడలేదు
Whoops! That page does not exist
Resource not found
The site is temporarily down, please check back later
An internal error has occurred
Server busy, try again in five minutes
You have been logged out, sign in again
Your account does not have permission to view this page
This content is blocked
Verify you are not a robot
503 Service Unavailable
HTTP 401 Unauthorized
ReferenceError: window is not defined
Fatal error: call to undefined function
Exception in thread worker
Connection to database lost, request failed
This website needs JavaScript to work properly
Scripts must be allowed to display the floor plan
You need to enable JavaScript to run this app
JavaScript required
Your browser is out of date and not supported
Bitte schalten Sie JavaScript ein
Es ist ein Fehler aufgetreten
Die Webseite ist zurzeit nicht verfügbar
Active JavaScript en el navegador para continuar
El servidor no responde, error 500
La sesión ha expirado
Ocorreu um erro inesperado
O site requer JavaScript
जावास्क्रिप्ट अक्षम है, कृपया इसे सक्रिय करें
त्रुटि: सर्वर से संपर्क नहीं हुआ
జావాస్క్రిప్ట్ అవసరం""",
    "filler": """Lorem ipsum dolor sit amet
consectetur adipiscing elit sed do eiusmod
Dummy text
This is sample copy and must be replaced
Placeholder paragraph
Your description goes here
Type your text here
Insert project summary here
Add content here
Text to follow
More details coming soon
To be filled in later
TBD
TODO write this part
Untitled document
Test entry, ignore
testing 123 testing 123
this is only a test please ignore
blah blah blah blah
zomira telanko vishbadu napelim korza
kelbru otamish frangu sivet lodruna pimsh
hugtar wopel jinsko drufem valtog peshku
narivo xelum tobrash gidunko fesh malkit urvo
asdf asdf asdf
qwerty qwerty
sdfg hjkl sdfg
wert uiop wert poiu
jkl jkl fgh
fghj fghj lkjh
xxx xxxx xxx
aaa aaa aaaa
Platzhaltertext
Hier folgt der Text
Dies ist ein Blindtext und wird ersetzt
Mustertext bitte austauschen
Texto de relleno
Aquí irá la descripción
Texto de prueba, reemplace este párrafo
Texto provisório
Aqui entra a descrição do imóvel
Substitua este texto
यहाँ पाठ लिखें
यह नमूना पाठ है, इसे बदलें
विवरण जल्द आएगा
येथे मजकूर लिहा
ఇక్కడ వివరణ వస్తుంది
నమూనా వచనం
Dummy description
Placeholder text for the gallery section
Project description goes here
Sample paragraph, replace before launch
qwerty asdf zxcv
lorem ipsum dolor sit
Dummy content for this block
Replace this paragraph with the project description
Your headline goes here
Hier steht bald Ihr Text
Aquí va el texto definitivo
asdfgh asdfgh asdfgh""",
    "slots": """Hello {{name}}
Dear [CUSTOMER NAME], thank you for calling
Hi {first_name}, your appointment is on {date}
Total amount: ${amount}
Kind regards, <<agent>>
Your order %ORDER_NO% has shipped
Meet __AGENT__ at the gate
Price from {{price}} onwards in {{project}}
Guten Tag Herr {{nachname}}, wir freuen uns
Hola [[nombre]], gracias por su visita
Prezado {{cliente}}, segue o contrato
नमस्ते {{naam}}, आपका भुगतान मिला
నమస్కారం {{peru}}, మీ సందర్శన ఖరారైంది
[INSERT ADDRESS]
{% if buyer %}
Dear {{salutation}} {{surname}}, we received your payment
Your unit [[unit_no]] will be ready in {{month}}
Thank you {name}, see you on {day}
Estimada {{nombre}}, su cita es el {{fecha}}
Liebe Frau {{name}}, Ihr Angebot liegt bei
Hi {{first_name}}, your loan of {{amount}} is approved
Dear [INSERT NAME], greetings from {{company}}""",
}

ORDINARY = """The buyer said the page showed not found when she opened the brochure
He told us the site kept asking for JavaScript so we sent the plan by mail
Her phone had scripts turned off and the agent explained another way
The client complained that the mail began with {{name}} and not with her name
The newsletter still prints {first_name} where the name belongs, marketing was told
Customer reported an error 500 on the portal yesterday
They wrote that the link had expired so we sent a new one
She forwarded a screenshot of an access denied message
The agent admitted an error in the price sheet
There was an error in the quotation which we corrected
An error in the area statement was found and a new one went out
The session with the banker ended before the papers were ready
The loan session expired, my brother said
He joked that the brochure reads like placeholder text
They asked whether the sample flat can be seen on Sunday
The sample flat is ready for visits
The dummy unit on floor 2 is only for show
The template of the agreement was sent to the lawyer
Please replace the tap in the kitchen before handover
We will replace the tiles before possession
The tester found the lift not working
The water test was done and the report is with the site office
Site visit fixed for Saturday
Our site is open on all days
The gate pass is not available on holidays
That flat is no longer available but the one above is
The unit on the third floor is not available
Parking is not available in this block
The service lift is down for maintenance this week
Power backup is under maintenance until Friday
Possession letters go out next month
The page in the brochure shows the floor plan
I saw your page and want to know the price
We came through the website page and not through an agent
Which page of the agreement has the clause
Access to the terrace is only for the penthouse
Access road is forty feet wide
Permission from the municipality is awaited
The permission was denied by the fire department, the builder appealed
Please call me back after six
Please call again tomorrow
Please sign the form again, the first copy was torn
Come back with your family at the weekend
I could not reach the sales office
The request for a discount was declined
My request is simple, a corner flat with two balconies
The server at the restaurant was kind
The connection for water will be given later
Can you enable the car lift for us
Please switch on the lights of the model flat
Turn on the motor in the morning
Activate the locker facility for my account
We need the keys by Monday
You need to pay ten percent at booking
The script of the play was written in Telugu
Description of the property: east facing villa with garden
Add one more parking slot to my booking
Insert the second page after the index
Type of flat needed is two bedroom
Coming soon to the same road is a metro station
The school is coming up soon near the lake
More towers are coming in phase two
Details are in the attached sheet
Text me the location
Send the text of the agreement
Ignore my last message, the budget is eighty lakhs
Please ignore the earlier rate, the new one holds
Is it tested for earthquake loads
Test results of the borewell are fine
He typed the wrong number in the form
Total comes to 84 lakhs with parking
Dear sir, thank you for the visit
Regards, sales team
Your visit to the project is fixed for 12 March
Budget noted and we will call you
Loan number 4456 is approved
Reference from my colleague
Reference number was given by the bank
Error free papers are all I ask for
The app of the builder is good
I filled the form on the portal yesterday
The portal has twelve photos of the flat
Home loan at nine percent
Back to the same topic, what about the price
Back side of the villa faces the park
Robots are used in the parking of this tower
Two hundred requests came for this project
Traffic on this road is unusual in the evening
The network of roads around is good
Bad network in the basement
Gateway of the township is under construction
The club house is under construction
Forbidden to keep pets, says the society
This block is temporarily closed for painting
ok
yes please
price?
possession?
3 bhk
call me
Where is the clubhouse
not interested now
No description was given by the owner so we measured the flat
The owner of the flat does not exist in the records, check the deed
This survey number does not exist in the map
The old listing was removed because the flat was sold
The flat was sold and the board was removed
Die Wohnung ist noch nicht verfügbar
Im Vertrag war ein Fehler, wir haben ihn korrigiert
Bitte rufen Sie später noch einmal an
Die Seite mit dem Grundriss habe ich gesehen
Wir schicken Ihnen den Text des Vertrags
Der Kunde schrieb, dass die Seite nicht gefunden wurde
Der Dienstag passt mir gut
El piso ya no está disponible pero hay otro
Hubo un error en el precio y lo corregimos
La página del folleto muestra el plano
El cliente dijo que la página daba error
Le enviamos el texto del contrato
Vuelva a llamar mañana por favor
O apartamento não está disponível este mês
Houve um erro na proposta e já corrigimos
A cliente disse que o site pedia para ativar o JavaScript
Ligue novamente amanhã
O texto do contrato segue em anexo
फ्लैट उपलब्ध नहीं है
पेज पर दिया हुआ दाम सही है क्या
कीमत में त्रुटि थी, ठीक कर दी
साइट पर कब आ सकते हैं
ग्राहक ने कहा कि पेज नहीं खुला
घर सापडले का
किंमत किती आहे
ఫ్లాట్ అందుబాటులో ఉందా
ధర ఎంత
సైట్ చూడటానికి రేపు వస్తాం
kal site pe aa sakte hain kya
price thoda zyada hai bhaiya
flat pasand aaya lekin loan ka dekhna hai
Meadow Heights - sunny villa in Rampur
Tower B, unit 1204, west facing, two car parks
Name Ramesh, phone on file, budget one crore
Kompally Medchal Shamirpet Gachibowli
granite counter modular kitchen wooden flooring
gated community swimming pool gymnasium
Customer asked for the carpet area of the duplex
agent sent the brochure of the row houses
The customer sounded happy and will visit with parents
It was noted that the enquiry came through a friend
He says the listing mentions a lake view which is wrong
She noticed that the advertisement has a wrong phone number
The brochure says that possession is in December
The mail reads as if it were sent to someone else
The desk should fix the greeting of the reminder mail
The customer was annoyed that the website showed an error for two days
Caller mentioned the form on the site did not submit, we took the details by phone
My son tried the link you sent and it said access denied
She wrote that the reminder still has {{name}} in it
I asked the bank to correct the error in my name
The approval is not available yet from the corporation
There is no lift in the old block
Is the corner villa still available
The broker went away and nobody was found at the gate
Maintenance charges are four rupees per square foot
The gym is closed for maintenance
Please update me on the loan
Please send the agreement again
We will try again next month
Could you refresh the quotation with the new rate
Let me see the sample flat and come back
Sample agreement was shared on mail
Test the taps before handover please
Text on the hoarding is wrong, said the neighbour
We need scripts of both lawyers
Go back from the junction and take the second left
The server room on the terrace makes noise
Connection charges are extra
The website says east facing but it is west facing
I saw the page of the brochure with the plan
Reload is not needed for the generator
Sign the papers in front of the notary
Your visit is at four
Description of the villa was fine
Todo el piso tiene luz natural
La página web dice otra superficie, comentó la clienta
O banco pediu outro documento
Die Küche ist neu und der Aufzug funktioniert
Der Makler sagte, die Seite sei fehlerhaft
दाम थोड़ा ज़्यादा है
ग्राहक ने बताया कि पेज पर गलत दाम है
ఇల్లు బాగుంది
Skyline Residency Manikonda Narsingi Kokapet
wooden flooring false ceiling wardrobes
bhaiya thoda kam karo na
Try the other gate, this one is locked
Please try the back door
Wait for my call
Log of visitors is kept by the guard
The link road is open now
The link between the two towers is a bridge
Refreshments were served at the visit
Slow traffic at the signal
Update on the lift please
Update the nominee in the form
The client noticed that the page had the wrong carpet area
Buyer told us that our site asked her for a captcha twice
Agent noted that the mail merge failed and {{name}} was printed on forty letters
The bank said the form failed because of a missing signature
My request for a change of flat was not approved
The lift failed twice in March
Not found any issue in the title search
There was no error in the sale deed
The service road is closed until June
The listing price is higher than what you told me
Session with the architect is at noon
I need permission of my father before paying
The connection to the drainage is pending
We allow small pets in the society
Please enable autopay for the maintenance bill
Activate my locker from Monday
Turn left at the temple and go on to the lake
You need to bring two photographs
Script for the function was ready
Coming to the site with family
Sample of the tile was approved by my wife
Replace the broken switch please
I will write the description of the damage
Ignore the rate card of last year
Text of the advertisement has to mention the parking
It was a test of patience to get the khata
Try to get us a corner unit
Please log the complaint about the leak
We will update the agreement after the valuation
The road to the site is temporarily diverted
The home page of the brochure has a lake
El banco no encontró errores en la escritura
La agencia no está disponible los domingos
O elevador falhou duas vezes
A proposta expirou ontem e pedimos outra
Der Aufzug ist nicht verfügbar
Der Preis auf der Seite war falsch, sagte der Kunde
फ्लैट में लिफ्ट नहीं है
साइट कब देख सकते हैं
రేపు సైట్ చూస్తాం
loan ka kaam kab tak hoga
marble flooring teak doors
park facing, third floor, two parkings
His phone had cookies and scripts blocked and we read the plan to him
The tablet had JavaScript off
The road is temporarily blocked
My tooth was not found to be the problem
No mistakes were found in the deed"""
