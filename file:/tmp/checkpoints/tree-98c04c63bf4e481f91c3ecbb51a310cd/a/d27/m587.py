x587