"""German words with umlauts or sharp s, and words that compounds are made of; inflected by rule."""

from __future__ import annotations

_ADJECTIVES = """allmählich ähnlich älter ängstlich ärgerlich ärztlich äußerlich auffällig ausführlich außergewöhnlich außerordentlich beständig
bläulich blöd böse bürgerlich dünn dürr durchschnittlich ehrgeizig eigentümlich einfältig endgültig erhältlich europäisch fähig fällig
falsch fest fleißig förmlich französisch fröhlich früh frühzeitig fünffach gefährlich gegenwärtig gemäßigt gemütlich geräumig geschäftlich
glücklich göttlich größer größt groß grün gründlich grundsätzlich günstig gültig gutmütig hässlich häufig häuslich heiß hübsch hölzern
höflich höher höchst höchstens jährlich jüdisch jünger jüngst kräftig königlich körperlich köstlich kühl künftig künstlerisch künstlich kürzer kürzlich
lächerlich länger längst ländlich läufig lässig mächtig männlich mäßig menschlich möglich müde mündlich mürbe mütterlich nächst nächtlich
nördlich nötig nützlich öde öffentlich ökologisch ökonomisch österreichisch östlich persönlich plötzlich pünktlich räumlich regelmäßig
rötlich rückständig sämtlich säuerlich schädlich schändlich schön schöner schriftlich schräg schüchtern schwäbisch schwächer schwärmerisch
selbstständig selbständig spät später städtisch ständig stärker stürmisch süß südlich südöstlich tätig täglich tödlich träge tüchtig
türkisch übel überflüssig überzeugend üblich übrig ungefähr ungewöhnlich unmöglich unnötig unzählig ursprünglich väterlich verfügbar
vergnügt vernünftig verständlich verschwörerisch volljährig vollständig vorläufig vorzüglich wählerisch wärmer weiß weiblich westfälisch willkürlich
wöchentlich wörtlich wünschenswert würdig wütend zärtlich zäh zahlreich zufällig zukünftig zulässig zusätzlich zuständig zuverlässig
zweckmäßig spröde dröge fünft zwölft mürrisch ausländisch inländisch zurückhaltend""".split()

_VERBS = """ändern ärgern äußern abhängen abkürzen abräumen abschließen anfügen anhören ankündigen anschließen aufhören aufklären aufräumen
ausdrücken ausführen ausfüllen aushändigen auslösen ausüben auswählen auszählen bedürfen beeinträchtigen befördern befürchten befürworten begrüßen
begründen begünstigen behüten bekämpfen bekräftigen bemühen benötigen benützen berücksichtigen berühren beschädigen beschäftigen beschließen
beschränken beschützen bestätigen betätigen betrügen bewältigen bewähren blühen brüllen bücken bügeln büßen dämmen dämpfen drängen drücken
düngen dürfen einführen einfügen einschätzen einschränken empören entblößen entfernen entführen entschädigen entschließen entschuldigen
enttäuschen ergänzen erfüllen ergötzen erhöhen erkälten erklären erläutern ermöglichen ermüden ernähren eröffnen ermäßigen erwägen erwähnen erwärmen
erzählen fällen färben fließen flößen flüchten flüstern fördern fügen fühlen führen füllen fürchten füttern gähnen gären gefährden gehören
genießen genügen gewähren gewährleisten gewöhnen gießen glänzen glätten glühen gönnen grüßen gründen grübeln hämmern hängen häufen hören hüllen hüten
hüpfen kämmen kämpfen kennenlernen klären knüpfen können kühlen kümmern kündigen küren kürzen küssen lächeln lähmen längen lärmen läuten leugnen löschen
lösen löten lüften lügen mähen mästen missverstehen mögen möchten müssen nähen nähern nähren nötigen nützen öffnen ölen ordnen pflücken pflügen
plündern prägen prüfen prügeln quälen quäken rächen räumen räuspern röntgen rösten rücken rühmen rühren rüsten säen sägen säubern säumen schälen schädigen
schämen schärfen schätzen schießen schlängeln schließen schlüpfen schmälern schmücken schnüren schöpfen schütteln schütten schützen schwächen
schwärmen schwören söhnen sprießen spülen spüren stärken stöhnen stören stoßen strömen stürmen stürzen stützen sühnen süßen tönen töten träumen trösten
trüben überleben überlegen übernehmen überprüfen überraschen überreden übersetzen übertragen übertreiben übertreten überwachen überweisen überwinden überzeugen
üben umhüllen unterdrücken unterstützen verärgern verändern verbrühen verdächtigen verfügen vergnügen vergrößern vergüten verkünden verlängern
verletzen vernachlässigen veröffentlichen verrücken verschärfen versöhnen verspäten verständigen verstärken verstoßen verzögern vorführen wählen
wälzen wägen währen wärmen wünschen würdigen würfeln würgen würzen wüten zählen zähmen zerstören zögern züchten zücken zünden zürnen zurückkehren zurückziehen
grüßen heißen reißen beißen schmeißen schweißen spaßen fassen lassen wissen essen messen vergessen passen""".split()

_NOUNS = """Box Heiz Rück Jürgen Mäxchen Herz Hoch Haupt Abkürzung Abfälle Abhängigkeit Abschlüsse Abstände Äcker Affäre Ägypten Ähnlichkeit Ähre Allergiker Alltag Älteste Ämter Änderung Anfänge Anfänger Anhänger Ängste
Ansprüche Anträge Äpfel Apfel Äquator Ära Ärger Ärmel Art Ärzte Ärztin Äste Ästhetik Äther Atmosphäre Aufklärung Auflösung Aufträge Aufführung Augenblick Ausdrücke Ausflüge
Ausführung Ausländer Auslöser Ausschüsse Auswüchse Auszüge Auto Autobahn Bäche Bäcker Bäckerei Bad Bäder Bahnhöfe Bahn Bälle Bände Bänke Bär Bären Bäuche Bauer Baum Bäume Bäuerin Bedürfnis Bedürfnisse
Begründung Begrüßung Behörde Beiträge Bekämpfung Bemühung Berg Berührung Beschäftigung Beschlüsse Beschränkung Bestätigung Bestandteil Bevölkerung Bezüge Blöcke Blüte Boden Böden
Bögen Börse Bösewicht Böschung Brände Bräuche Bräutigam Brötchen Brücke Brüche Brüder Brühe Brüssel Brüste Bücher Buch Büchse Büffel Bügel Bühne Bündel Bündnis Bürde Bürger Bürgermeister Bürgersteig
Büro Bürste Büsche Büste Chöre Dächer Dach Dämme Dämmerung Dämon Dänemark Därme Diät Dörfer Dorf Dübel Düfte Düne Dünger Durchschnitt Düse Düsseldorf Eier Einflüsse Einführung Einkünfte Einwände
Eltern Empfänger Empörung Entschlüsse Entschuldigung Enttäuschung Entwürfe Erdöl Erdgeschoß Erfüllung Ergänzung Erhöhung Erkältung Erklärung Ernährung Eröffnung Erwähnung Erzähler Erzählung Fächer
Fädchen Fäden Fähigkeit Fähre Fährte Fälle Fälscher Fälschung Fänger Farbe Fässer Fäuste Fenster Feuer Flächen Fläche Fläschchen Flöhe Flöte Flüche Flüchtling Flüge Flügel Flüsse Flüssigkeit Förderung
Förster Fräse Fräulein Freizügigkeit Fröhlichkeit Frösche Frost Früchte Frucht Frühling Frühstück Füchse Fügung Führer Führung Fülle Fünf Fürst Füße Fuß Fußball Fußgänger Gänge Gang Gänse Gärten Garten Gärtner
Gäste Gast Gebäck Gebäude Gebärde Gebühr Gebühren Gebüsch Gedächtnis Gefährte Gefälle Gefängnis Gefäß Gefühl Gefühle Gegensätze Gegenstände Gehör Geländer Gelände Gelächter Gemälde Gemäuer Gemüse Gemüt Generäle Geräusch
Gerät Geräte Gerücht Gerüche Gerüst Geschäft Geschäfte Geschöpf Geschoß Geschütz Geschwätz Geschwür Gespräch Gespräche Geständnis Getränk Getränke Gewächs Gewächshaus Gewähr Gewässer Gewölbe Gewürz Gläser Gläubiger
Glück Glückwunsch Glühbirne Götter Göttin Gräben Gräber Gräser Grenze Gründe Gründer Gründung Grüße Gruß Größe Großeltern Großmutter Großvater Großstadt Gürtel Güte Güter Häfen Hälfte Hälse Hämmer Händchen Hände Händler
Hand Hänge Häppchen Häuschen Häuser Haus Häute Hersteller Herzöge Höfe Höflichkeit Höhe Höhepunkt Höhle Hölle Hölzer Hörer Hörner Hüfte Hügel Hühner Hülle Hülse Hündchen Hürde Hüte Hütte Hüter Jäger Jahr Jahrhundert Jüngling
Jünger Kabinett Käfer Käfig Kälte Kämme Kämpfe Kämpfer Kanäle Kapitän Käse Käufer Kindergarten Kind Kinder Klänge Kläger Kläranlage Klöster Knäuel Knöchel Knödel Knöpfe Koch Köche Köchin Köder Koeffizient Köln Könige König Königin Köpfe Körbe Körner
Körper Kopf Kräfte Kraft Krähe Kräne Kränze Kräuter Krönung Kröte Krümel Krüge Küche Kuchen Küchlein Kübel Küche Kühe Kühlschrank Kühlung Künstler Künste Kürbis Kürze Küsse Küste Küster Läden Länder Land Längen Länge Lärm Läufer Läuse
Leitfäden Löcher Löffel Löhne Lösung Löwe Lücke Lüfte Lüftung Lüge Lügner Macht Mächte Mädchen Mädel Mähne Männer Mann Mängel Mäntel Märchen März Märtyrer Mäuse Mauer Maß Maße Maßnahme Maßstab Messgerät Militär Milliardär Mißbrauch Möbel Möglichkeit
Mönch Mörder Mörtel Möwe Mücke Mühe Mühle Müll Müller München Münze Mündung Münster Mütter Mütze Muße Nächte Nacht Nachträge Nadel Näherin Nähe Nägel Nässe Nöte Nüsse Öfen Öffentlichkeit Öffnung Öl Ölpreis Öle Ökologie Österreich Ostern Pädagoge Päckchen Pässe
Pfähle Pfänder Pförtner Pfütze Pläne Plan Plätze Platz Plüsch Pöbel Preis Präsident Prüfer Prüfung Puder Püree Quäker Quälerei Qualität Querschnitt Rädchen Räder Rad Ränder Räte Rätsel Räuber Räume Raum Reise Relikt Röcke Röhre Römer Röntgenbild Röte Rübe Rückblick
Rücken Rückfahrt Rückgang Rückkehr Rücksicht Rücktritt Rüstung Rüssel Säbel Säcke Säfte Säge Säle Sänger Sängerin Särge Sättel Sätze Satz Säule Säure Säugling Schädel Schäden Schädling Schäfer Schädigung Schätze Schätzung Scheußlichkeit Schicksal Schiff Schläge Schläger
Schlösser Schloß Schlüssel Schlüsse Schlüsselbund Schmetterling Schnäpse Schönheit Schöpfer Schöpfung Schoß Schränke Schrank Schrägen Schülerin Schüler Schule Schüssel Schüsse Schütze Schützen Schwäche Schwäne Schwänze Schwärmer Schweiß Schwimm Schwimmbad Schwimmbäder Schwüre Schwester Söhne
Soße Späher Späße Spaß Spätzle Spiel Spieler Spieß Sprüche Sprünge Stäbe Städte Stadt Stämme Ständer Stärke Stätte Stöcke Stöhnen Störung Stößel Stoß Stöße Strafe Strände Strände Straße Straßen Straßenbahn Sträucher Sträuße Strauß Ströme Strömung Strümpfe Stück Stücke Stühle Stümper
Stürme Sturm Stürze Stütze Süden Sühne Sümpfe Sünde Sünder Süd Süß Süßigkeit Süßwasser Tänze Tänzer Täter Tätigkeit Tätowierung Tag Täler Tälchen Täuschung Tische Tisch Töchter Töne Töpfe Töpfer Tor Träger Tränen Träne Träume Träumer Tröge Trümmer Tücher Tücke Tüte Tümpel Tünche Tür Türen Türkei Türme Turm
Übel Überblick Überfall Überfluss Übergang Überlegung Übermut Übernahme Überraschung Überschrift Überschuss Übersetzer Übersetzung Übersicht Übertragung Überzeugung Übung Übungen Uhr Umstände Unfälle Universität Unterschied Unterstützung Väter Vater Veränderung Verbände Verdächtiger Verfügung Vergnügen Verhältnis
Verhältnisse Verkäufer Verlängerung Vermögen Veröffentlichung Verspätung Verstärker Verständnis Verstöße Verträge Vögel Vogel Völker Volk Vorgänger Vorräte Vorschläge Vorsätze Vorwürfe Vorzüge Wächter Wände Wand Wäsche Wäscherei Wähler Währung Wälder Wald Wälle Wärme Wärter Wasser Weg Welt Werk Wäsche
Wohnungstür Wölfe Wörter Wort Wörterbuch Wünsche Wunsch Würde Würfel Würmer Wurst Würstchen Würste Würze Wüste Wut Zähler Zähne Zahn Zänkerei Zäune Zeit Zeitgenössin Ziel Zögling Zölle Zöpfe Züchter Züge Zug Zündung Zürich Zuschüsse Zuschlag Zuständigkeit Zwänge Zwölf Zylinder""".split()

_FIXED = """ab aber aßen vergaßen saßen lasen als am an auf aus außen außer außerdem außerhalb äußerst bei bis bloß da dafür dass dagegen demgemäß der die das draußen dürfte dürften du ein
er es etwas für fürs früher fünf fünfzehn fünfzig gegenüber gemäß genau gern hätte hätten hättest heißt hinüber hinten ihr ich im in
ja je jährlich käme könnte könnten könntest läge längs lässt lief ließ ließe ließen mit möchte möchten möchtest möge müsste müssten nach nämlich nah natürlich neben nicht
nun nur ob oder oft ohne rückwärts rüber schließlich schön sehr sei seit selbst sie so soll spräche ständig stünde tschüß tschüss über überall überdies überhaupt
überlegen übermorgen übers überein übrigens um und unter unüblich verläuft fährt fällt fängt gäbe gebläse ginge hält hängt lädt lässt läuft lägen nähme rät schlägt schläft
stößt stünden täte trägt träfe vor vorüber während wäre wären wärst wäscht wächst weiß weißt wenn wer wie wir wo würde würden würdest wüsste wüssten zu zunächst zuäußerst zurück zwölf
genießt gießt schießt schließt fließt grüßt stoßen verließ vergaß saß aß maß besaß fraß süß abenteuerlich kongruent Abenteuer größtenteils bräuchte bräuchten
dürft dürfte kürzlich längst möglichst höchst nächste neulich fröhlich mäßig regelmäßig gleichmäßig ausschließlich einschließlich anschließend abschließend unermüdlich""".split()


def _inflected() -> set[str]:
    words = set(_FIXED)
    for a in _ADJECTIVES:
        base = a[:-1] if a.endswith("e") else a
        words |= {a, *(base + x for x in ("e", "en", "em", "er", "es", "ere", "eren", "erer", "ste", "sten", "heit", "keit"))}
    for v in _VERBS:
        stem = v[:-2] if v.endswith("en") else v[:-1]
        link = "e" if stem[-1] in "td" or stem.endswith(("ffn", "chn", "dn", "gn")) else ""
        past = [stem + link + x for x in ("te", "ten", "test", "tet", "t", "st")] + [stem + "t"] * stem.endswith(("ß", "z", "s"))
        words |= {v, stem + "e", stem, stem + "end", stem + "ende", stem + "enden", v + "d", *past, "ge" + stem + link + "t", *(stem + link + "t" + x for x in ("e", "en", "er", "es"))}
        words |= {stem[0].upper() + stem[1:] + x for x in ("ung", "ungen", "er", "erin")} | {v[0].upper() + v[1:]}
    for n in _NOUNS:
        words |= {n, n + "s", n + "n", n + "en", n + ("es" if n[-1] in "sßzxtdbgkf" else "s")}
        if n.endswith(("ung", "heit", "keit", "schaft", "tät")):
            words.add(n + "en")
    return words


WORDS = frozenset(_inflected())
