x443