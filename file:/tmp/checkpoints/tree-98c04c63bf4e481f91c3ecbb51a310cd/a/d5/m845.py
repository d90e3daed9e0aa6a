x845