from loomspark.operators.metadata import metadata_edges, metadata_files

NS = 'xmlns="http://soap.sforce.com/2006/04/metadata"'
FILES = [
    ("f/objects/Ad__c/Ad__c.object-meta.xml", f"<CustomObject {NS}><label>Ad</label></CustomObject>"),
    ("f/objects/Ad__c/fields/Owner__c.field-meta.xml", f"<CustomField {NS}><type>Lookup</type><referenceTo>Account</referenceTo></CustomField>"),
    ("f/objects/Ad__c/validationRules/Must.validationRule-meta.xml", f"<ValidationRule {NS}><active>true</active><errorConditionFormula>ISBLANK(Owner__c) || Gone__c</errorConditionFormula></ValidationRule>"),
    ("f/permissionsets/P.permissionset-meta.xml", f"<PermissionSet {NS}><objectPermissions><allowCreate>true</allowCreate><allowEdit>false</allowEdit><allowRead>true</allowRead><object>Ad__c</object></objectPermissions><fieldPermissions><editable>false</editable><field>Ad__c.Owner__c</field><readable>true</readable></fieldPermissions><classAccesses><apexClass>Svc</apexClass><enabled>true</enabled></classAccesses></PermissionSet>"),
    ("f/layouts/Ad__c-Main.layout-meta.xml", f"<Layout {NS}><layoutItems><field>Owner__c</field></layoutItems><layoutItems><field>Name</field></layoutItems></Layout>"),
    ("f/flows/Go.flow-meta.xml", f"<Flow {NS}><start><object>Ad__c</object><triggerType>RecordAfterSave</triggerType></start><recordLookups><object>Ad__c</object><filters><field>Owner__c</field></filters></recordLookups><actionCalls><apexClass>Svc</apexClass></actionCalls></Flow>"),
    ("f/flows/Broken.flow-meta.xml", "<Flow><start>"),
    ("src/Main.java", "class Main {}"),
]


def test_metadata_edges(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    assert {r.id for r in metadata_files(files).collect()} == {"object:Ad__c", "field:Ad__c.Owner__c", "rule:Ad__c.Must", "permissionset:P", "layout:Ad__c-Main", "flow:Go"}
    got = {tuple(r) for r in metadata_edges(files).collect()}
    assert got == {
        ("field:Ad__c.Owner__c", "object:Ad__c", "belongs_to", None),
        ("rule:Ad__c.Must", "object:Ad__c", "belongs_to", None),
        ("layout:Ad__c-Main", "object:Ad__c", "belongs_to", None),
        ("field:Ad__c.Owner__c", "object:Account", "references", None),
        ("rule:Ad__c.Must", "field:Ad__c.Owner__c", "references", None),
        ("layout:Ad__c-Main", "field:Ad__c.Owner__c", "shows", None),
        ("flow:Go", "object:Ad__c", "references", None),
        ("flow:Go", "object:Ad__c", "triggers_on", None),
        ("flow:Go", "field:Ad__c.Owner__c", "references", None),
        ("flow:Go", "name:Svc", "calls", None),
        ("permissionset:P", "object:Ad__c", "grants", "create,read"),
        ("permissionset:P", "field:Ad__c.Owner__c", "grants", "readable"),
        ("permissionset:P", "name:Svc", "grants", None),
    }
