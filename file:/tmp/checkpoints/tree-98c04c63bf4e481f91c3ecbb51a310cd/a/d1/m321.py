x321