x570