x962