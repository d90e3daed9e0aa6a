x917