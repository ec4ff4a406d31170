"""Record types, as DDL strings."""

REQUEST = "seedUrl string, includeSubpages boolean, depth int, operationMode string, outputFormat string, orgName string, processId string"
JOB_EVENT = "job_id string, seq long, ts timestamp, kind string, value string, completed long, total long"
