x279