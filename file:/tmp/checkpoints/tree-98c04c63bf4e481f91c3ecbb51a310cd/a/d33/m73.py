x73