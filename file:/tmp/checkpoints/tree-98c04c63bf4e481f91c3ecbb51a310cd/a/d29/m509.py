x509