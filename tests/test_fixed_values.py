"""Fixed values of the taxonomy, the edits and the checks: a change of any of them shows here."""

import hashlib
import importlib
import json

import pytest

PINNED = {
    ("taxonomy", "FAULTS"): "7aaf9b01e5354c5d4cc1a095511fd1f4",
    ("taxonomy", "CATEGORIES"): "2cda4d69f0d00b9c14f4423f719fdcf1",
    ("faults_hcl", "REQUIRED_ARGUMENTS"): "386cc7f25c0ea44d92db2d5a097e8f85",
    ("faults_hcl", "TYPE_TYPOS"): "5338335675809cfa49d22de149548428",
    ("faults_hcl", "WRONG_ZONES"): "1e374a1bf09acca5417695638f771836",
    ("faults_hcl", "BAD_AMI"): "bc7d81a217f24f5aa057acb5ecf362c6",
    ("faults_hcl", "BAD_CIDR"): "03cd7fd5e8963a7b15e585d9160d53a7",
    ("faults_hcl", "BAD_REGION"): "d5869ddc6e980e30ae8ea874cfb71b91",
    ("faults_hcl", "BAD_MODULE"): "cedc6969956e938afa5a08872560f3ab",
    ("faults_hcl", "BAD_VERSION"): "9411832aaee556acb1dcd6e8eed7814d",
    ("faults_hcl", "NETWORK_IDS"): "cf8666cf8246d0cfb1732e48a0199283",
    ("faults_hcl", "SAYS"): "25c23445aff04e0c873ec4d8ce0b0da2",
    ("faults_hcl", "ENCRYPTION"): "c729e46499d20a30daee5a80bbd44a5f",
    ("faults_hcl", "OPEN_INGRESS"): "d1cdca39c2ac7011a2d689279cbdbd9e",
    ("faults_hcl", "AMI"): "8ee5c4817b29c089a0c1d5844bbd2d52",
    ("faults_hcl", "CIDR"): "3a18694debf7177f29738f2902944703",
    ("faults_hcl", "REGION"): "7b77f23a4e755996289cdbebdec391a3",
    ("faults_hcl", "ZONE"): "fe423513830495da14920bdc216e21dc",
    ("faults_hcl", "VERSION"): "71d2e618bf3bfd81014d36ae9ff5cfe8",
    ("faults_hcl", "SOURCE_LINE"): "7c87417eca3197b09e080633dbad1034",
    ("faults_hcl", "SOURCE_VALUE"): "57596bfc90f80a7b3cf28f3ba042c102",
    ("faults_hcl", "DEPENDS_ON"): "25379a794dbad689e15a4dec77cc3ffd",
    ("faults_hcl", "NUMBER_VALUE"): "f41d18bfd159d692fd27cbcbdc954fcf",
    ("faults_hcl", "BOOLEAN_VALUE"): "ea9031af9a0b5e67cd30f1aac9591884",
    ("faults_hcl", "EQUALS"): "7ff20fb5819ca73be4cb74772236a104",
    ("faults_template", "REQUIRED_PROPERTIES"): "117c8b23fe9a7883daf308a3762175cf",
    ("faults_template", "TYPE_TYPOS"): "df450e1ba65ee16becab427e3d7a8e98",
    ("faults_template", "BAD_VALUES"): "e048dd92d131438b62601a6c74d251ab",
    ("faults_template", "ENCRYPTION_PROPERTIES"): "59798b70d5135ddad6d4198ed867db97",
    ("faults_template", "BAD_AMI"): "bc7d81a217f24f5aa057acb5ecf362c6",
    ("faults_template", "BAD_CONDITION"): "fbd513457f6fe25aea47bbd077a579c5",
    ("faults_template", "BAD_JOIN"): "c476a0f7c1d5195a5c2df2bebe4c30eb",
    ("faults_template", "SAYS"): "a09238d9eaa9297e483a279c4b83c4fd",
    ("faults_template", "OPEN_SUB"): "8be43a69cda93bceb598f4537732ff43",
    ("faults_template", "OPEN_RULE"): "c36b096c654dbed8c3e9a780fd2c9510",
    ("checks", "REGION"): "2804157420e53c070d2eb0d67e9f3736",
    ("checks", "ENCRYPTION_ARGUMENTS"): "35a39af897968c99ea7935beae306c2f",
}


@pytest.mark.parametrize("module,name", PINNED)
def test_value_is_as_pinned(module, name):
    value = getattr(importlib.import_module(f"mendset.operators.{module}"), name)
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)
    assert hashlib.md5(text.encode()).hexdigest() == PINNED[module, name]


def test_samples_in_plain_text():
    from mendset.operators import faults_hcl, taxonomy

    assert len(taxonomy.FAULTS) == 37 and taxonomy.FAULTS[0][:3] == ("SYNTACTIC", "missing_closing_brace", "low")
    assert faults_hcl.BAD_CIDR == "999.999.999.999/33"
    assert faults_hcl.REQUIRED_ARGUMENTS["aws_subnet"] == ["vpc_id", "cidr_block"]
