"""Token-labelled sentences from which the tagger is trained.

WARNING: the examples are offensive by purpose. A line is a category and a sentence; in braces stand slots that are filled at random.
Category A: a person is insulted, threatened or degraded; H: a group of people is; S: sexually explicit; O: none of these, though the
words may be the same (technical, medical, culinary and historical use, rules, reports that condemn, grumbling about oneself).
All tokens of a line have its category. Groups are invented, so the tagger learns the talk about a group, not names.
"""

from __future__ import annotations

import random

SLOTS = {
    "adj": "worthless filthy spineless disgusting useless brainless stupid pathetic miserable rotten ugly vile dumb fat lazy sick".split(),
    "insult": "loser|piece of trash|jackass|cretin|dimwit|dumbass|waste of space|scumbag|moron|idiot|halfwit|imbecile|bastard|parasite|fool|pig|clown|rat|coward|creep|asshole|bitch|dickhead|freak|nobody|failure|piece of shit|sack of dirt|lowlife|retard".split("|"),
    "noun": "draft corner label schedule folder note table list plan review page report index query oven barley bridge lamp lens garden hinge saddle voucher budget chapter outline team archive method".split(),
    "name": "quill_07 mossv ember-two wren-3 orra42 tarn.v fennick_k dapple-07 Marta Jonas Felix Nora".split(),
    "group": [f"<group{i}>" for i in range(12)],
    "vermin": "rats mould flies vermin cockroaches parasites lice mice".split(),
    "day": "Monday the weekend lunch dawn noon the evening tonight".split(),
    "dear": "darling baby gorgeous honey sexy sweetheart".split(),
    "bare": "naked|undressed|nude|topless|with nothing on|out naked|out undressed".split("|"),
    "body": "breasts bottom chest body thighs belly".split(),
    "porn": "porn|sex|xxx|hardcore porn|uncut porn|filthy porn".split("|"),
}
PREFIXES = ["PS:", "Honestly:", "Listen.", "Once more:", "Update:", "And another thing about the {noun}.", "To whoever reads the {noun} page:"]

LABELLED = """
A|You are a {adj} {insult} and everyone here knows it.
A|You are nothing but a {adj} {insult}.
A|You {adj} {insult}, get out of here.
A|What a {adj} little {insult} you turned out to be.
A|What a {adj} {insult} you are.
A|Only a complete {insult} would leave the {noun} like that.
A|Your own mother must be ashamed of such a {adj} {insult}.
A|Do everyone a favour and crawl back into your hole.
A|Do us all a favour and crawl back under your rock.
A|Do the whole {noun} a favour and crawl back to the gutter you came from.
A|Nobody would miss you, so just drop dead, {insult}.
A|Nobody would notice you, so just disappear, {insult}.
A|Nobody would mourn you, so just jump off something high, {insult}.
A|Go to hell and take your {adj} {noun} with you.
A|Go kill yourself, nobody wants you here.
A|I hope you choke on your {noun}, you {adj} {insult}.
A|I hope you die slowly, you {insult}.
A|People like you should never have been born.
A|People like you should never have been given a key to the {noun}.
A|People like you should never have been let near this {noun}.
A|Stay away, {name}, or you will end up in the ditch.
A|Watch your back, I know where you live and I will come for you.
A|Watch your back, I know where you sleep and I will hurt you.
A|Watch your back, I know where you park and I will make you bleed.
A|If I see you near my {noun} again I will break your fingers.
A|If you come back I will break your neck.
A|I will find you and I will kill you.
A|Keep talking and you will be picking your teeth out of the {noun}.
A|Everyone laughs at you behind your back, and they are right to.
A|You ruin everything you touch; the world was better before you showed up.
A|I have seen garden slugs with more brains than you, {name}.
A|I despise you, {name}, you lying sack of dirt.
A|I hate you, {name}, you {adj} {insult}.
A|Get lost, you {insult}, nobody asked for your {noun}.
A|Shut up, you {insult}, nobody asked for your {noun}.
A|Shut your mouth, you {insult}, nobody asked for your {noun}.
A|Just quit, {insult}, your {noun} makes people sick.
A|Espèce d'imbécile, tu ne vaux rien.
A|Espèce de {frinsult}, tu ne vaux rien.
A|Ferme-la, pauvre crétin, personne ne veut de toi.
A|Ta gueule, sale {frinsult}, personne ne veut de toi.
A|Va te faire foutre, pauvre {frinsult}.
A|Je vais te casser la figure si tu reviens.
A|Je vais te tuer si tu reviens ici.
A|Halt die Klappe, du Vollidiot.
A|Halt die Fresse, du {deinsult}.
A|Du bist ein wertloser Versager, verschwinde endlich.
A|Du bist ein dummer {deinsult}, verschwinde endlich.
A|Ich schlage dir die Zähne aus, wenn du wiederkommst.
A|Ich bringe dich um, wenn du wiederkommst.
H|All {group} are subhuman, whatever the {noun} says.
H|The {group} breed like {vermin} and spoil every {noun}.
H|The {group} breed like {vermin} and steal every {noun}.
H|The {group} breed like {vermin} and ruin every {noun}.
H|The {group} are a plague and must be driven out of every street.
H|The {group} are parasites and must be beaten out of every village.
H|The {group} are vermin and must be kept from every town.
H|The {group} are animals, all of them, and deserve no mercy.
H|I spit on the {group}; they are a disease in this town.
H|I hate all {group}, they should go back where they came from.
H|No {group} should be allowed near our {noun}, their kind is filth.
H|Never hire the {group}, they are all thieves by birth.
H|Never trust the {group}, they are all liars by birth.
H|Never marry the {group}, they are all traitors by birth.
H|It is in the blood of the {group} to lie, cheat and infect the rest of us.
H|Whoever marries one of the {group} betrays us all and should be cast out.
H|Decent people do not let {group} sit at the same table.
H|The only good {noun} for the {group} is a locked gate and a deep pit.
H|The only good {group} is a dead one.
H|We should burn the houses of the {group} and dance around the fire.
H|One day the {group} will be wiped out and nobody will miss them.
H|One day the {group} will be hunted down and nobody will bury them.
H|One day the {group} will be gone for good and nobody will bury them.
H|Send the {group} back across the marsh, we owe them nothing but a kick.
H|Drag the {group} back across the marsh, their place is in the mud.
H|Whip the {group} back across the border, their place is in the mud.
H|Tous les {group} sont des voleurs de naissance.
H|Tous les {group} sont des menteurs de naissance.
H|Les {group} sont de la vermine, il faut les chasser.
H|Alle {group} sind Diebe, das liegt denen im Blut.
H|Alle {group} sind Lügner, das liegt denen im Blut.
H|Die {group} sind Ungeziefer und gehören vertrieben.
H|{group} raus, wir wollen die hier nicht.
S|Send nudes tonight, I am so horny I cannot sleep.
S|Send nudes right now, I am so turned on I cannot wait.
S|Send nudes after work, I am so horny I cannot think.
S|I want to undress you completely and make you scream my name all night.
S|I want to strip you slowly and make you beg all night.
S|I want to kiss and lick you slowly and make you moan all weekend.
S|Tell me what you are wearing under that, then take it off slowly for me, {dear}.
S|Tell me what you are wearing in bed, then peel it off for me, {dear}.
S|She lay {bare} on the bed and begged him to take her.
S|She knelt {bare} on the rug and begged him for sex.
S|She stretched {bare} on the sofa and begged him not to stop.
S|He could not stop staring at her bare {body} while she rode him.
S|He could not stop squeezing her bare {body} while she climbed on top of him.
S|Her hand slid between his thighs until he came.
S|His mouth slid down her belly until she shuddered and came.
S|Her tongue slid under the sheet until he came.
S|We tore our clothes off behind the {noun} and made love until dawn.
S|We tore our clothes off behind the {noun} and went at it until noon.
S|We ended up without a stitch on behind the {noun} and did it twice until the lamp went out.
S|Looking for a discreet hookup, anything goes, bring your toys.
S|Looking for a kinky threesome, anything goes, bring the handcuffs.
S|Looking for a discreet one-night stand, anything goes, bring a friend.
S|Free porn links: orgies, bondage, wet and willing grown-ups.
S|Free porn archive: swingers, threesomes, wet and willing grown-ups.
S|Free porn collection: strip shows, threesomes, wet and willing grown-ups.
S|Uncensored {porn} videos of wild couples, adults only, no sign-up.
S|Uncensored 18+ clips of horny couples, adults only, no card needed.
S|Uncensored {porn} streams of married couples, adults only, no card needed.
S|Hot nude singles on live cam, join for {porn}.
S|Lonely naked singles on private cam, click for {porn}.
S|Mature topless singles on live cam, call for {porn}.
S|Watch her strip and touch herself next to the {noun}.
S|Watch them undress on camera and play with each other next to the {noun}.
S|Watch him undress on camera and get off next to the {noun}.
S|He pushed his cock deep into her and fucked her hard.
S|Vidéos porno gratuites, couples nus en direct.
S|Envoie-moi des photos de toi toute nue, je suis chaud ce soir.
S|Schick mir Nacktbilder, ich bin so geil auf dich.
S|Kostenlose Pornos, nackte Paare live vor der Kamera.
O|Kill the parent process and wait until every child is dead.
O|Kill the stale worker and restart the {noun}.
O|Add a dummy variable and strip the trailing spaces.
O|Marinate the chicken breasts, then pound the dough and beat the eggs.
O|Whip the cream, beat the eggs and strip the husks.
O|Breast cancer screening is offered to all patients over fifty.
O|Breast milk is kept cold in the ward for two days.
O|Cockpit, cocktail and other innocent words must pass the word filter.
O|With the naked eye the comet was only a smudge.
O|Rule 4: posts that call another member a {insult} are removed.
O|Rule 2: whoever calls someone a {adj} {insult} is banned for a week.
O|Calling people {insult} or worse is against the rules of this {noun}.
O|Rats breed fast, so set the traps before the frost.
O|The flies breed in the wet {noun} and spoil every apple.
O|Garden parasites: aphids, slugs and other vermin to keep out.
O|Slugs and rats in the garden are vermin and must be kept from every bed.
O|The trait is sex-linked and shows up in every second litter.
O|The sex of the bird is told by its tail.
O|She threw the manuscript on the fire, and the villain of chapter two hated her for it.
O|In chapter three the villain calls him a coward and a fool.
O|I made a stupid mistake in my own regex and felt like an idiot for an hour.
O|I am such an idiot, I forgot the {noun} again.
O|I feel useless today and my own {noun} is rotten.
O|Report any message asking for nudes to the shelf keeper.
O|Report any message that threatens or insults you to the {noun} keeper.
O|A bastard file cuts faster than a smooth one on soft brass.
O|The dumb terminal hung, so we had to shoot down the whole node.
O|The hot path and the kinky cable are both replaced.
O|He was hell-bent on fixing the damn queue before lunch.
O|Sexual health leaflets are in the second drawer of the clinic.
O|The doctor explained intercourse, consent and contraception to the class.
O|The nurse undressed the wound and washed his bare chest.
O|The old pamphlet calls the {group} vermin, a claim this essay condemns at length.
O|The newspaper of that year called the {group} thieves, which this report condemns.
O|The {group} delegation was driven out of the valley in the old war, a crime still mourned.
O|The {group} harvest fair was a joy, and the {group} choir sang twice.
O|The {group} were hunted and many of their houses burned, a crime the museum remembers.
O|Most {group} live by the river and keep bees.
O|One day the {group} will sing at our fair and nobody will miss it.
O|We should visit the {group} and dance around the fire.
O|Never miss the {group} market, they are all bakers by trade.
O|Left here on purpose so that nobody has to search for it
O|Skip this page if you have already read the short one
O|To be continued once the missing half turns up
O|Thanks to everyone who helped with the last round of fixes
O|Nothing else to report from this side so far
O|Remember to move this to the right folder before the month ends
O|Back to the {noun} overview | previous page | next page of the {noun}
O|Late or not, this {noun} belongs to the {noun}.
O|Rather than a new {noun}, a late {noun} might do.
O|Three ways to see the {noun}: as a {noun}, as a {noun}, or as something broad.
O|With 25 of the {noun} checked, half the {noun} is behind us.
O|Next step: get the {noun} renamed so that the {noun} is not late.
O|It is the {noun} that matters, because a late {noun} can be checked at {day}.
O|Leave a star at the bottom of the {noun} page
O|Join the {noun} letter and get one {noun} every second week
O|Please do not forward pages of {noun} outside the {noun} circle
O|The opinions in this {noun} are those of the writer and not of the {noun}
O|Exported 7.8.2025 at 10:34 from the {noun}, revision 44
O|Copyright 2022 the keepers of the {noun}, all pages may be quoted with a link back
O|The {noun} says that each {noun} gets checked slowly.
O|Better short than late, somebody wrote beside the {noun}.
O|Compared with the {noun}, our {noun} seems steady and the {noun} late.
O|If the {noun} stays dim, the {noun} should be checked first.
O|You are reading an automatic copy of the {noun}, the link may be out of date.
O|Nobody checked the {noun} until the late {noun} came back.
O|Whoever checked the {noun} should have renamed the {noun} too.
O|No {noun} explains why the {noun} keeps being late.
O|Share this page with a friend who likes the {noun} corner.
O|Nothing here is advice; check every {noun} with somebody who knows.
O|I lost the {noun}; luckily the {noun} was already checked.
O|Keep the {noun} steady and have the {noun} renamed at {day}.
O|Some advice from the {noun}: stay steady, and measure the {noun} twice.
O|Do the {noun} well and start with the {noun}.
O|Hier, le projet était presque prêt et la liste aussi.
O|Il faut relire le carnet avant de classer la version.
O|Je garde le plan près de la liste pour 12 jours.
O|Pourquoi le brouillon est-il encore ouvert alors que la fiche ne change pas ?
O|On a déplacé le dossier, mais la remarque est trop longue.
O|Gestern war die Liste schlecht sortiert, und der Plan ebenso.
O|Danach wird die Notiz geprüft, bevor das Heft umzieht.
O|Seit 12 Tagen ist die Frage noch offen.
O|Im Ordner liegt die Rechnung, aber das Rezept ist sehr nützlich.
O|Warum der Plan so lang ist, erklärt der Bericht nicht.
A|You make me sick, you {adj} little {insult}.
A|Nobody here can stand you, you {insult}, so pack your things.
A|How can anyone be as {adj} as you, {name}?
A|{name}, you are the most {adj} {insult} I have ever met.
A|{name} is a {adj} {insult} and always was one.
A|{name} is a lying {insult} who should be ashamed to show a face in public.
A|What a {insult} that {name} is, too {adj} to read a {noun}.
A|Only a {adj} {insult} like {name} could write such a {noun}.
A|I will smash your teeth in if you open your mouth again.
A|I am going to beat you until you can't stand.
A|I'll burn your house down with you inside.
A|We are coming to your door tonight and you will beg for your life.
A|One more word from you and I will slit your throat.
A|Say that again and I will put you in hospital.
A|You deserve to rot, you {insult}.
A|You should hang yourself and save us the trouble.
A|The world would be better off if you were dead.
A|Your brain must be made of mud, {name}.
A|Are you really that stupid, or do you just write like it, {insult}?
A|You are a disgrace, too {adj} and too {adj} for this work.
A|Fuck you, you {adj} {insult}.
A|Piss off, {insult}, and never come back.
A|Screw you and your {adj} {noun}, you {insult}.
A|Tu es un pauvre {frinsult} et tout le monde le sait.
A|Dégage, espèce de {frinsult}, on ne veut plus te voir.
A|Verpiss dich, du {deinsult}, keiner will dich hier.
A|Du {deinsult} bist zu blöd für alles.
H|Exterminate every last one of the {group}.
H|Kill all the {group}, down to the last child.
H|The {group} ought to be exterminated like {vermin}.
H|All {group} should be shot or gassed.
H|Wipe the {group} off the face of the earth.
H|We must get rid of the {group} before they outnumber us.
H|{group} are not human, they are {vermin}.
H|{group} are inferior by nature and should serve their betters.
H|Every one of the {group} is a criminal, it is how they are made.
H|Keep {group} out of our schools, they are dirty and stupid.
H|The {group} are a cancer on this country.
H|I can't stand the {group}, the whole lot of them is scum.
H|Being one of the {group} is a sickness and they should be locked up.
H|These {group} only come here to steal and to rape.
H|Round up the {group} and throw them into the sea.
H|Hang the {group} from the lamp posts.
H|God hates the {group} and so do we.
H|You can tell a {group} by the smell, filthy beasts all of them.
H|Il faut exterminer tous les {group}.
H|Les {group} sont des sous-hommes, qu'ils crèvent.
H|Man sollte alle {group} vergasen.
H|Die {group} sind Untermenschen und gehören ausgerottet.
S|I want you naked in my bed, {dear}, spreading your legs for me.
S|I want to taste every inch of your wet body, {dear}.
S|My cock is hard for you, come over and suck it.
S|She moaned as he thrust into her again and again.
S|He licked her nipples and slid two fingers inside her.
S|She got down on her knees and took him in her mouth.
S|He came all over her {body} and she begged for more.
S|Watch hot girls fuck on webcam, free sign-up.
S|Barely dressed milfs want sex in your town tonight.
S|Blowjobs, anal and group sex, full uncensored scenes inside.
S|Meet me at the hotel for sex, no strings, I will ride you all night.
S|I am so wet right now, touch yourself for me, {dear}.
S|Masturbating to your picture every night, {dear}.
S|Je veux te baiser toute la nuit, ma belle.
S|Elle gémissait pendant qu'il la prenait par derrière.
S|Ich will dich die ganze Nacht ficken, Süße.
S|Sie stöhnte, als er tief in sie eindrang.
O|The moderator banned {name} after an insult in the {noun} thread.
O|The moderators deleted the threat and warned the account that sent it.
O|A user was suspended for calling another member a {insult}.
O|The police report says that the man threatened his neighbour with a knife.
O|She was called a {insult} at school, and the teacher stepped in at once.
O|He was bullied for years, called {adj} and {adj} by his class.
O|The court found that the leaflet, which called the {group} {vermin}, was incitement.
O|The article condemns those who say that the {group} are {vermin}.
O|The regime murdered thousands of the {group}; the memorial lists their names.
O|Historians describe how the {group} were driven from their homes and killed.
O|The law protects the {group} from hatred and violence.
O|In the Middle Ages the plague was carried by rats and fleas and killed a third of the town.
O|The plague reached the port by ship, and rats spread it through every street.
O|The black death came with fleas on rats, and whole villages died of it.
O|Rats carried the disease from house to house until the winter.
O|Condoms protect against HIV and other infections if they are used every time.
O|The clinic hands out condoms and leaflets on HIV and safe sex.
O|Safe sex advice: use a condom, get tested, talk to your doctor.
O|The vaccine protects against a virus that is passed on through sex.
O|The lesson covers puberty, periods, contraception and consent.
O|The midwife examined the breast and showed how to feed the baby.
O|The patient undressed behind the screen and the doctor listened to his chest.
O|The nude in the painting lies on a red cloth, and her bare shoulders catch the light.
O|Mating season: the male mounts the female, and she lays two eggs.
O|The penis bone of the walrus is on show in the museum of natural history.
O|Slurs, threats and porn are not allowed in this {noun}; report them to a moderator.
O|Hate speech against any group is removed and the account is banned.
O|The novel was banned in 1930 for a scene in which the two undress.
O|The villain shouts that he will kill them all, and the curtain falls.
O|I could kill for a coffee, and this {noun} is killing me.
O|My {noun} is a stupid mess and I hate mondays.
O|I am a useless cook and a worse gardener.
O|Kill the weeds, crush the slugs, and drown the beetles in soap.
O|Exterminate the cockroaches before the guests come.
O|The {group} came for the harvest, danced with us and left at dawn.
O|Many of the {group} work at the mill and send their children to our school.
O|Shoot the scene again, then cut the throat of the jacket pattern.
O|Le rapport condamne ceux qui traitent les {group} de vermine.
O|Der Bericht verurteilt, dass die {group} als Ungeziefer beschimpft wurden.
O|Der Moderator hat den Nutzer wegen einer Beleidigung gesperrt.
O|Le modérateur a supprimé les insultes et averti leur auteur.
O|Kondome schützen vor HIV und anderen Infektionen.
O|I felt like such an idiot when I lost my ticket.
O|I was a fool to trust the weather.
O|What a fool I have been, I left my keys in the door.
O|We were lazy on Sunday and slept until noon.
O|My dog is a fat old beast who sleeps on my bed.
O|Her little cat hates the vacuum and hides under the sofa.
O|That dumb machine ate my coins again.
O|The stupid alarm went off at four again.
O|The horse kicked the farmer and broke his leg.
O|A dog bit my neighbour, and she needed three stitches.
O|He fell from the ladder and broke two fingers.
O|She was hit by a car and died in hospital.
O|The thief hit the guard on the head and ran away.
O|Please sand the boards before you paint them.
O|Please wash your hands before you touch the dough.
O|Strip the wallpaper, fill the holes and sand the wall.
O|Strip the insulation from the wire before you solder it.
O|Wear gloves to protect yourself and others from the acid.
O|Take this pill to protect yourself from malaria.
O|Use sunscreen to protect yourself and your children.
O|You should see a doctor if you have chest pain.
O|You can ask your partner to come along to the exam.
O|Tell your doctor about any drugs you use.
O|Our teacher says that nobody should call another child names.
O|My mother taught me never to call people stupid.
O|Parents were told not to let children call each other idiots.
O|Children learn early that it hurts to be called ugly or fat.
O|The statue of a nude boy was cleaned and put back in the park.
O|The gallery shows nude drawings and portraits from two centuries.
O|The sculptor carved a naked goddess out of white stone.
O|This film is for adults only because of its violence.
O|The game is rated for adults and contains strong language.
O|The book has scenes of violence and sex and is not for children.
O|Adults pay eight, children four, and dogs are free.
O|In the fourteenth century the plague killed half of the people.
O|Fleas on rats brought the plague to the towns of Europe.
O|During the famine many people in the villages died of hunger.
O|Ships brought rats, and the rats brought disease.
O|The army burned the town and killed many of the people who lived there.
O|In the war his family was driven out of the country, and their house was burned.
O|The soldiers were ordered to shoot, and many of the {group} died.
O|The museum of the {group} tells how they were hunted and murdered.
O|The minister was sharply criticised for words against the {group}.
O|A senator called the {group} thieves and had to resign.
O|He was fined for shouting abuse at a referee.
O|The victims of abuse are offered advice and shelter.
O|The inquiry into sexual abuse at the school lasted two years.
O|The report on sexual violence names those who looked away.
O|The {group} are known for their songs, their bread and their bridges.
O|The {group} settled here long ago and planted the first vines.
O|My neighbours are {group} and we often eat at the same table.
O|Our cats are animals of habit, all of them.
O|Pigs are clever animals and deserve better barns.
O|Mice eat the seed, so we keep a cat in the barn.
O|We need to replace the pump before it is too late.
O|We need to leave now or we will miss the last train.
O|All members should be asked before the house is sold.
O|No child should be allowed near the saw.
O|Everyone in the office thinks that you did good work.
O|You are a good friend, and everyone here knows it.
O|You are the best cook I have ever met.
O|I hope you get well soon and come back to us.
O|I hope you find your cat before the frost.
O|I know your brother, and I am going to see him at noon.
O|If you come back on Friday I will bake a cake.
O|If you see my sister again please give her this letter.
O|Shut the door and keep the dog inside.
O|Go home, have some soup and sleep.
O|Get out of the house at once if the alarm rings.
O|He pulled off his boots and hung his coat by the stove.
O|He held her hand until the train left.
O|She kissed the baby and put it to bed.
O|She took the bread out of the oven and ate it hot.
O|Send me the pictures of the bridge, please, I need them tonight.
O|I want to show you all of the garden, slowly, when you come.
O|Looking for a room, quiet, with a garden, from March.
O|Looking for a used bike, any colour, bring it along.
O|Free lessons, new videos every day, click here to join.
O|Hot soup, warm bread and a free coffee for everyone who comes.
O|New films every day, no card needed, watch on any screen.
O|The couple got married on a boat and danced all night.
O|Cover the bed with a sheet and press the dough with your fingers.
O|The rooster mounts the hen, and a day later she lays an egg.
O|Drown the onions in butter, then smash the garlic.
O|Beat the carpet, burn the leaves and kill the moss.
O|Cut the throat of the fish behind the gills and bleed it at once.
O|Our team was beaten badly, and the coach was sick about it.
O|Die Ärztin untersuchte die Brust der Patientin.
O|Das Museum zeigt, wie die {group} verfolgt und ermordet wurden.
O|Der Hund biss den Nachbarn ins Bein.
O|Le chien a mordu le facteur, qui est allé au médecin.
O|Le musée raconte comment les {group} furent chassés.
O|Le film est réservé aux adultes.
O|Old towns lost many of their people to fevers that the rats brought.
O|A bee stung the baker and she had to go home.
O|The goose bit a boy and he had to see a nurse.
O|Our horse is a gentle old thing who hates the wind.
O|That lazy little dog of ours is asleep again.
O|His goat is a clever animal that likes the rain.
S|Vidéos de sexe gratuites avec des femmes toutes nues.
S|Des couples nus font l'amour en direct, inscription gratuite.
O|Le peintre a montré des femmes nues au bord de l'eau.
H|We have to exterminate the {group} before they ruin us all.
H|It is time to exterminate the {group} for good.
H|Let us wipe out the {group} before winter.
H|Someone has to get rid of the {group}, they do not deserve to live.
""".strip().split("\n")
SLOTS["frinsult"] = "imbécile crétin connard salaud abruti idiot raté".split()
SLOTS["deinsult"] = "Vollidiot Versager Idiot Arschloch Trottel Dummkopf Penner Schwachkopf".split()


def sentences(each: int = 14, seed: int = 9) -> list[tuple[str, str, str]]:
    """(prefix without category, sentence, category) with slots filled."""
    rng, out = random.Random(seed), []

    def filled(s: str) -> str:
        while "{" in s:
            at = s.index("{")
            name = s[at + 1 : s.index("}", at)]
            s = s[:at] + rng.choice(SLOTS[name]) + s[at + len(name) + 2 :]
        return s

    for line in LABELLED:
        category, _, s = line.partition("|")
        for _ in range(each if "{" in s else max(6, each // 2)):
            prefix = filled(rng.choice(PREFIXES)) if rng.random() < 0.3 else ""
            out.append((prefix, filled(s), category))
    return out
