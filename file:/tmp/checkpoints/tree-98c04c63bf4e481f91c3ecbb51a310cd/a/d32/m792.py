x792